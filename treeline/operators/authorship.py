"""Who owns, started, maintains and may orphan a file or a directory: nine metrics of contributor shares.

Contributions are first summed per node and author over four windows at once: the whole life, the early part of the node's
own life, the recent days before the head date. The metrics are then ranks and conditional sums over these few rows. A
directory's metrics are computed from all contributions below it, not from its files' metrics.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.operators import tree
from treeline.session import materialise

# The two marks that stand in for an author.
UNMAINTAINED = "«unmaintained»"
OTHER = "«other»"
DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Settings:
    activity_days: int = 180
    recent_days: int = 180
    early_fraction: float = 0.25
    significant_share: float = 0.10
    bus_share: float = 0.50
    top_k: int = 11


def contributions(facts: DataFrame, node: Column) -> DataFrame:
    """(node, email, at_us, w): the dated, authored contributions of each node; NULL lines count as 0."""
    w = F.coalesce("added", F.lit(0)) + F.coalesce("removed", F.lit(0))
    at = F.unix_micros(F.col("touched_at").cast("timestamp"))
    return facts.where("author_email IS NOT NULL AND touched_at IS NOT NULL").select(node.alias("node"), F.col("author_email").alias("email"), at.alias("at_us"), w.alias("w"))


def _cutoffs(spans: DataFrame, s: Settings) -> DataFrame:
    """(node, cutoff): the end of the early part of each node's life; spans: node, oldest, newest."""
    return spans.select("node", (F.col("oldest") + ((F.col("newest") - F.col("oldest")) * s.early_fraction).cast("bigint")).alias("cutoff"))


def _records(rows: DataFrame, head_us: int, s: Settings) -> DataFrame:
    """Sums per node and author of contributions that know their node's cutoff."""
    recent_from = head_us - s.recent_days * DAY_US
    early, recent = F.col("at_us") <= F.col("cutoff"), F.col("at_us") >= recent_from
    return rows.groupBy("node", "email").agg(
        F.sum("w").alias("weight"),
        F.min("at_us").alias("first"),
        F.sum(F.when(early, F.col("w"))).alias("early_weight"),
        F.min(F.when(early, F.col("at_us"))).alias("early_first"),
        F.sum(F.when(recent, F.col("w"))).alias("recent_weight"),
        F.min(F.when(recent, F.col("at_us"))).alias("recent_first"),
        F.max(F.col("cutoff") > recent_from).alias("overlap"),
        F.max(F.when(early & (F.col("w") != 0), True).otherwise(False)).alias("was_early"),
    )


def author_records(contrib: DataFrame, head_us: int, s: Settings = Settings()) -> DataFrame:
    """(node, email, weight, first, early and recent weight and first, overlap): one row per node and author."""
    span = contrib.groupBy("node").agg(F.min("at_us").alias("oldest"), F.max("at_us").alias("newest"))
    return _records(contrib.join(_cutoffs(span, s), "node"), head_us, s)


def directory_records(of_files: DataFrame, head_us: int, s: Settings = Settings()) -> DataFrame:
    """author_records of every directory, from the contributions to all files below it.

    Contributions are summed per directory, author and moment first. A directory's rows then meet the list of its ancestors
    with their cutoffs (as long as the path is deep) in a join on the directory, and only after that are they repeated. So no
    join or shuffle has the root as its key but that of sums which each task has made per node and author.
    """
    per = of_files.withColumn("dir", tree.parent_of(F.col("node"))).where("dir IS NOT NULL").groupBy("dir", "email", "at_us").agg(F.sum("w").alias("w"))
    per = materialise(per)
    spans = per.groupBy("dir").agg(F.min("at_us").alias("oldest"), F.max("at_us").alias("newest"))
    of_nodes = tree.to_ancestors(spans).groupBy(F.col("node_path").alias("node")).agg(F.min("oldest").alias("oldest"), F.max("newest").alias("newest"))
    above = tree.to_ancestors(spans.select("dir", F.col("dir").alias("below"))).withColumnRenamed("node_path", "node")
    lists = above.join(_cutoffs(of_nodes, s), "node").groupBy(F.col("below").alias("dir")).agg(F.collect_list(F.struct("node", "cutoff")).alias("nodes"))
    return _records(per.join(lists, "dir").select("email", "at_us", "w", F.inline("nodes")), head_us, s)


def ranked(records: DataFrame) -> DataFrame:
    """records with share and rank: weight falling, then earlier first contribution, then e-mail."""
    node = Window.partitionBy("node")
    order = node.orderBy(F.desc("weight"), "first", "email")
    return records.withColumn("total", F.sum("weight").over(node)).where("total > 0").withColumn("share", F.col("weight") / F.col("total")).withColumn("rank", F.row_number().over(order))


def metrics(records: DataFrame, last_active: DataFrame, head_us: int, s: Settings = Settings()) -> DataFrame:
    """(node, the nine metrics). last_active: email, last_us over all commits; an author missing there counts as inactive."""
    active_from = head_us - s.activity_days * DAY_US
    node = Window.partitionBy("node")
    order = node.orderBy(F.desc("weight"), "first", "email")
    total = F.sum("weight").over(node)
    rows = (
        records.join(last_active, "email", "left")
        .withColumn("total", total)
        .withColumn("share", F.when(F.col("total") > 0, F.col("weight") / F.col("total")))
        .withColumn("rank", F.row_number().over(order))
        .withColumn("upto", F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )

    def leader(weight: str, first: str) -> Column:
        # of several with one weight and first contribution the smallest e-mail: min_by over the negated order
        by = F.struct((-F.col(weight)).alias("w"), F.col(first).alias("f"), F.col("email").alias("e"))
        return F.min_by("email", F.when(F.col(weight).isNotNull(), by))

    has = F.max("total") > 0
    entropy = -F.sum(F.when(F.col("share") > 0, F.col("share") * F.log("share"))) / F.log(F.count("*"))
    orphan = F.sum(F.when(F.coalesce(F.col("last_us") < active_from, F.lit(True)), F.col("weight")).otherwise(0))
    recent = F.coalesce(F.sum("recent_weight"), F.lit(0))
    fresh = F.coalesce(F.sum(F.when(~F.col("was_early"), F.col("recent_weight"))), F.lit(0))
    zero = F.lit(0.0)
    return rows.groupBy("node").agg(
        F.when(F.coalesce(F.sum("early_weight"), F.lit(0)) > 0, leader("early_weight", "early_first")).otherwise(UNMAINTAINED).alias("initial_developer"),
        F.when(recent > 0, leader("recent_weight", "recent_first")).otherwise(UNMAINTAINED).alias("current_maintainer"),
        F.when(has, leader("weight", "first")).otherwise(UNMAINTAINED).alias("code_owner"),
        F.count_if(F.col("share") >= s.significant_share).alias("significant_contributor_count"),
        F.when(has, F.coalesce(F.min(F.when(F.col("upto") >= s.bus_share, F.col("rank"))), F.max("rank"))).otherwise(0).cast("bigint").alias("bus_factor"),
        F.coalesce(F.max("share"), zero).alias("ownership_dominance"),
        F.when(has & (F.count("*") > 1), F.coalesce(entropy, zero)).otherwise(zero).alias("contributor_entropy"),
        F.when(has, orphan / F.max("total")).otherwise(zero).alias("orphan_risk"),
        F.when(F.max("overlap") | (recent == 0), zero).otherwise(fresh / recent).alias("knowledge_handoff"),
    )


def new_recent_authors(records: DataFrame) -> DataFrame:
    """(node, email, recent_weight): authors of the recent window without an early contribution (an anti join on flags)."""
    early = records.where("was_early").select("node", "email")
    return records.where("recent_weight IS NOT NULL").join(early, ["node", "email"], "left_anti").select("node", "email", "recent_weight")


def top_authors(contrib: DataFrame, k: int = 11) -> DataFrame:
    """(email, weight, first): the k authors with the greatest weight over all files."""
    per = contrib.groupBy("email").agg(F.sum("w").alias("weight"), F.min("at_us").alias("first"))
    return per.orderBy(F.desc("weight"), "first", "email").limit(k)


def bucket_identities(rows: DataFrame, top: DataFrame, columns: Iterable[str]) -> DataFrame:
    """rows with every author outside the top k replaced by «other»; top has at most k rows."""
    for c in columns:
        known = F.broadcast(top.select(F.col("email").alias("_known")))
        rows = rows.join(known, F.col(c) == F.col("_known"), "left")
        rows = rows.withColumn(c, F.when(F.col(c) == UNMAINTAINED, F.col(c)).when(F.col("_known").isNotNull(), F.col(c)).otherwise(OTHER)).drop("_known")
    return rows


def apply_mailmap(rows: DataFrame, mailmap: DataFrame, email: str = "author_email", name: str = "author_name") -> DataFrame:
    """rows with e-mail and name in their canonical form; mailmap: old_email (lower case), proper_email, proper_name."""
    mm = mailmap.select("old_email", "proper_email", "proper_name")
    out = rows.join(F.broadcast(mm), F.lower(F.col(email)) == F.col("old_email"), "left")
    return out.withColumn(email, F.coalesce(F.nullif("proper_email", F.lit("")), F.col(email))).withColumn(name, F.coalesce(F.nullif("proper_name", F.lit("")), F.col(name))).drop("old_email", "proper_email", "proper_name")
