"""Change history: the fact of one row per commit and changed path, and what is computed from it per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOURS_PER_MONTH = 24 * 30.44
MICROS_PER_HOUR = 3_600_000_000


def touch_facts(touches: DataFrame) -> DataFrame:
    """One row per touch_id; of exact repeats one stays. Columns nobody asks for are neither read nor shuffled."""
    return touches.where("touch_id IS NOT NULL").dropDuplicates(["touch_id"])


def touches_of(commits: DataFrame) -> DataFrame:
    """(commit_hash, file_path, ...): a commit table's changed paths, one row each."""
    return commits.select(*(c for c in commits.columns if c != "changed_paths"), F.explode("changed_paths").alias("file_path"))


def tracked(facts: DataFrame, files: DataFrame) -> DataFrame:
    """The facts whose (repo_slug, file_path) is among the files."""
    return facts.join(files.select("repo_slug", "file_path").distinct(), ["repo_slug", "file_path"], "left_semi")


def changed_against_all_parents(facts: DataFrame) -> DataFrame:
    """(repo_slug, commit_hash, file_path): changes that differ from every parent of their commit.

    facts has a row per parent a path differs from (parent_idx). A commit with at most one parent needs one row; a merge
    needs one for each parent, else it only brought the change along.
    """
    per = facts.groupBy("repo_slug", "commit_hash", "file_path").agg(F.count_distinct("parent_idx").alias("seen"), F.max("n_parents").alias("n_parents"))
    return per.where(F.col("seen") >= F.greatest(F.coalesce("n_parents", F.lit(1)), F.lit(1))).select("repo_slug", "commit_hash", "file_path")


def file_changes(touches: DataFrame) -> DataFrame:
    """One row per (repo_slug, commit_hash, file_path) that the commit itself changed: author, moment, creation, lines.

    touches has a row for each parent that the path differs from; repeats of them do no harm. A merge that agrees with one
    of its parents only brought the change along and is left out. Lines are those against the first parent.
    """
    first = F.col("parent_idx") == 0
    per = touches.where("commit_hash IS NOT NULL AND file_path IS NOT NULL").groupBy("repo_slug", "commit_hash", "file_path")
    rows = per.agg(
        F.size(F.collect_set("parent_idx")).alias("seen"),  # no more than a commit has parents
        F.greatest(F.coalesce(F.max("n_parents"), F.lit(1)), F.lit(1)).alias("parents"),
        F.max("author_email").alias("author_email"),
        F.max("touched_at").alias("touched_at"),
        F.max("is_creation").alias("is_creation"),
        F.max(F.when(first, F.col("added"))).alias("added"),
        F.max(F.when(first, F.col("removed"))).alias("removed"),
    )
    return rows.where("seen >= parents").drop("seen", "parents")


def _whole_days(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / (24 * MICROS_PER_HOUR)).cast("bigint")


def file_history(facts: DataFrame, as_of: Column) -> DataFrame:
    """The seven history metrics per (repo_slug, file_path) in one aggregate; files without dated changes have none.

    facts: see file_changes. as_of stands for the moment of asking. Lines of creations count for nothing. Months are floored at 1 in the density.
    """
    at = F.col("touched_at").cast("timestamp")
    edits = F.when(~F.coalesce("is_creation", F.lit(False)), F.lit(1))
    per = (
        facts.where("touched_at IS NOT NULL")
        .groupBy("repo_slug", "file_path")
        .agg(
            F.min(at).alias("oldest"),
            F.max(at).alias("newest"),
            F.count_distinct("author_email").alias("author_count"),
            F.count("*").alias("commit_count"),
            F.coalesce(F.sum(edits * F.col("added")), F.lit(0)).alias("total_lines_added"),
            F.coalesce(F.sum(edits * F.col("removed")), F.lit(0)).alias("total_lines_removed"),
        )
    )
    months = (F.unix_micros("newest") - F.unix_micros("oldest")) / (MICROS_PER_HOUR * HOURS_PER_MONTH)
    return per.select(
        "repo_slug",
        "file_path",
        _whole_days(as_of, F.col("oldest")).alias("file_age"),
        _whole_days(as_of, F.col("newest")).alias("file_freshness"),
        "author_count",
        "commit_count",
        "total_lines_added",
        "total_lines_removed",
        (F.col("commit_count") / F.greatest(F.lit(1.0), months)).alias("commit_density"),
    )


def time_ranges(facts: DataFrame) -> DataFrame:
    """(repo_slug, file_path, earliest, latest)."""
    return facts.where("touched_at IS NOT NULL").groupBy("repo_slug", "file_path").agg(F.min("touched_at").alias("earliest"), F.max("touched_at").alias("latest"))


def overall_range(ranges: DataFrame) -> DataFrame:
    """(earliest, latest) of all ranges."""
    return ranges.agg(F.min("earliest").alias("earliest"), F.max("latest").alias("latest"))


def last_active(facts: DataFrame) -> DataFrame:
    """(author_email, last_active): over all facts, tracked or not."""
    return facts.where("author_email IS NOT NULL").groupBy("author_email").agg(F.max("touched_at").alias("last_active"))


def first_parent_lines(facts: DataFrame) -> DataFrame:
    """(repo_slug, file_path, added, removed): churn against the first parent only."""
    first = facts.where("parent_idx = 0")
    return first.groupBy("repo_slug", "file_path").agg(F.sum(F.coalesce("added", F.lit(0))).alias("added"), F.sum(F.coalesce("removed", F.lit(0))).alias("removed"))


def require_history(facts: DataFrame) -> DataFrame:
    """facts; raises ValueError if no file has any."""
    if facts.isEmpty():
        raise ValueError("none of the files has a history")
    return facts
