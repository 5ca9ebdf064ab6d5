"""Metric expressions rolled up the tree: one fused aggregate per fact table.

Facts are first combined per directory that holds them; only these partial results are repeated for the ancestors. Every
verb is computed from partials that add up (count, sum, min, max; for texts the count of each value), so results are those
of all facts below a directory, never aggregates of aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.operators import tree
from treeline.plans.expr import Resolved
from treeline.plans.registry import CLASSIFICATION, COMMIT, DECLARATION, FILE, QUANTITY


def declaration_predicate(r: Resolved) -> Column:
    """Which declarations an expression is about: the kinds of its metric and its visibility filter."""
    kinds = F.lit(True) if r.metric.decl_kinds is None else F.col("kind").isin(*r.metric.decl_kinds)
    return kinds & (F.col("visibility") == r.expression.filter) if r.expression.filter else kinds


def fact_value(r: Resolved, columns: Sequence[str]) -> Column:
    """The value of a fact row for an expression, NULL if it has none."""
    if r.metric.level != DECLARATION:
        return F.col(f"`{r.expression.stored_name}`")
    name = r.expression.base
    if r.expression.aggregation == "count":
        return F.when(declaration_predicate(r), F.lit(1))
    return F.when(declaration_predicate(r), F.col(f"`{name}`") if name in columns else F.lit(1))


def _partials(i: int, value: Column) -> list[Column]:
    return [F.count(value).alias(f"n{i}"), F.sum(value).alias(f"s{i}"), F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}")]


def _merged(i: int) -> list[Column]:
    return [F.sum(f"n{i}").alias(f"n{i}"), F.sum(f"s{i}").alias(f"s{i}"), F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}")]


def _verb(i: int, r: Resolved) -> Column:
    n, s, lo, hi = (F.col(f"{p}{i}") for p in ("n", "s", "lo", "hi"))
    value = {"sum": s, "min": lo, "max": hi, "count": n, "mean": s / n, "range": hi - lo}[r.expression.aggregation]
    value = F.when(n > 0, value)
    return (value.cast("bigint") if r.kind == QUANTITY else value.cast("double")).alias(r.name)


def _numeric(facts: DataFrame, key: str, wanted: Sequence[Resolved], up: bool) -> DataFrame:
    parts = facts.groupBy(F.col(key).alias("dir")).agg(*(c for i, r in enumerate(wanted) for c in _partials(i, fact_value(r, facts.columns))))
    if up:
        parts = tree.to_ancestors(parts).groupBy("node_path").agg(*(c for i in range(len(wanted)) for c in _merged(i)))
    else:
        parts = parts.withColumnRenamed("dir", "node_path")
    return parts.select("node_path", *(_verb(i, r) for i, r in enumerate(wanted)))


def _texts(facts: DataFrame, key: str, wanted: Sequence[Resolved], up: bool) -> DataFrame:
    """mode (ties: the smallest text) and distinct, from the count of each value."""
    names = list(dict.fromkeys(r.expression.stored_name for r in wanted))
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in names)))
    counts = facts.select(F.col(key).alias("dir"), pairs.alias("p")).where("p.value IS NOT NULL").groupBy("dir", "p.metric", "p.value").agg(F.count("*").alias("n"))
    if up:
        counts = tree.to_ancestors(counts).groupBy("node_path", "metric", "value").agg(F.sum("n").alias("n"))
    else:
        counts = counts.withColumnRenamed("dir", "node_path")
    order = Window.partitionBy("node_path", "metric").orderBy(F.desc("n"), "value")
    best = counts.withColumn("rank", F.row_number().over(order)).groupBy("node_path", "metric")
    per = best.agg(F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("mode"), F.count("*").alias("distinct"))
    columns = [F.max(F.when(F.col("metric") == r.expression.stored_name, F.col(r.expression.aggregation))).alias(r.name) for r in wanted]
    return per.groupBy("node_path").agg(*columns)


def rollup(facts: dict[str, DataFrame], wanted: Sequence[Resolved], target: str = "directory") -> DataFrame:
    """(node_path, one column per expression) at directories or, for declarations, at files.

    facts: by level (file, declaration, commit) rows with dir (the directory of the file) and, for target file, file_path.
    A file row has a column per stored metric (filtered ones as filter.metric); a declaration row has kind, visibility and
    its metrics. A node without values of an expression has NULL there, and no row if it has none at all.
    """
    key = "dir" if target == "directory" else "file_path"
    up = target == "directory"
    parts = []
    for level in (FILE, DECLARATION, COMMIT):
        numeric = [r for r in wanted if r.metric.level == level and (r.metric.kind != CLASSIFICATION)]
        texts = [r for r in wanted if r.metric.level == level and r.metric.kind == CLASSIFICATION]
        if numeric:
            parts.append(_numeric(facts[level], key, numeric, up))
        if texts:
            parts.append(_texts(facts[level], key, texts, up))
    joined = reduce(lambda a, b: a.join(b, "node_path", "full"), parts)
    names = [f"`{r.name}`" for r in wanted]
    return joined.select("node_path", *names).where(" OR ".join(f"{n} IS NOT NULL" for n in names))


def long_form(wide: DataFrame, wanted: Sequence[Resolved]) -> DataFrame:
    """(node_path, metric, kind, q, m, c) of a rolled-up table."""
    def cell(r: Resolved) -> Column:
        c = F.col(f"`{r.name}`")
        return F.struct(
            F.lit(r.name).alias("metric"),
            F.lit(r.kind).alias("kind"),
            (c if r.kind == QUANTITY else F.lit(None)).cast("bigint").alias("q"),
            (c if r.kind == "measure" else F.lit(None)).cast("double").alias("m"),
            (c if r.kind == CLASSIFICATION else F.lit(None)).cast("string").alias("c"),
        )

    rows = wide.select("node_path", F.explode(F.array(*map(cell, wanted))).alias("x")).select("node_path", "x.*")
    return rows.where("q IS NOT NULL OR m IS NOT NULL OR c IS NOT NULL")


def size_with_floor(files: DataFrame, size: str) -> DataFrame:
    """(node_path, total) of each directory: the files' sizes, each at least 1."""
    floor = F.when(F.col(size).isNull() | (F.col(size) <= 0), F.lit(1.0)).otherwise(F.col(size).cast("double"))
    per = files.groupBy("dir").agg(F.sum(floor).alias("total"))
    return tree.to_ancestors(per).groupBy("node_path").agg(F.sum("total").alias("total"))
