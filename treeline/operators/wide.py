"""Entity-attribute-value rows into one typed row per entity, by characteristic sets.

An entity's characteristic set is the exact set of attributes it has; entities that share a set form a dense table with just
those columns, and the tables are unioned by name, absent columns becoming NULL. Where nearly every entity has a set of its
own (each file with its own choice of 25 metrics) one table a set would mean as many plans as entities. So the sets are
merged into at most `max_tables` groups: a tree parts them by the presence of the attribute that spares the most NULLs, and a
group's table has the columns of its own sets only. All rows pass through the table of their group; a set that stands alone
in its group keeps its exact table. The tree is learned from the counts of all sets, and the rows are written once, by group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import values as V
from treeline.plans.registry import CLASSIFICATION, MEASURE, QUANTITY, names_by_kind
from treeline.session import materialise

TYPES = {QUANTITY: "bigint", MEASURE: "double", CLASSIFICATION: "string"}


def metric_cells(rows: DataFrame, registry=None) -> DataFrame:
    """(entity, attribute, kind, q, m, c, at, tie) of the usable rows of a metric_values table.

    The metric's name is brought into registry form and decides the kind; the row's own metric_kind is ignored. Rows
    without path, name or usable value are left out. NULL loaded_at counts as the earliest time.
    """
    names = names_by_kind(registry)
    kind = F.when(F.col("attribute").isin(*names[QUANTITY]), QUANTITY).when(F.col("attribute").isin(*names[MEASURE]), MEASURE).otherwise(CLASSIFICATION)
    text = F.col("text")
    # name, text and kind are columns of their own so that each is computed once a row
    read = rows.select(F.col("node_path").alias("entity"), V.kebab(F.col("metric")).alias("attribute"), V.usable_text(F.col("raw_value")).alias("text"), F.col("loaded_at").alias("at"), F.col("entry_id").alias("tie"))
    typed = read.where("entity IS NOT NULL AND attribute <> '' AND text IS NOT NULL").withColumn("kind", kind)
    valued = typed.withColumns(
        {
            "q": F.when(F.col("kind") == QUANTITY, V.whole_text(text)),
            "m": F.when(F.col("kind") == MEASURE, V.decimal_text(text)),
            "c": F.when(F.col("kind") == CLASSIFICATION, text),
        }
    )
    return valued.where("q IS NOT NULL OR m IS NOT NULL OR c IS NOT NULL").drop("text")


def latest_cells(cells: DataFrame) -> DataFrame:
    """The value with the greatest (at, tie) of each entity and attribute; a max, so it combines before the shuffle."""
    best = F.max(F.struct(F.col("at"), F.col("tie"), F.col("q"), F.col("m"), F.col("c"))).alias("v")
    return cells.groupBy("entity", "attribute", "kind").agg(best).select("entity", "attribute", "kind", "v.q", "v.m", "v.c")


def characteristic_sets(latest: DataFrame) -> DataFrame:
    """One row per entity: its attribute set `sig` (sorted names) and one map per kind."""

    def typed(kind: str, value: str) -> Column:
        return F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("attribute", value)))).alias(f"{value}s")

    return latest.groupBy("entity").agg(
        F.array_sort(F.collect_list("attribute")).alias("sig"),
        typed(QUANTITY, "q"),
        typed(MEASURE, "m"),
        typed(CLASSIFICATION, "c"),
    )


@dataclass
class Group:
    """A group of merged sets: how many entities it has, its attributes with their entities, and how it is parted further."""

    n: int = 0
    columns: dict[str, int] = field(default_factory=dict)
    split: str | None = None
    has: Group | None = None
    lacks: Group | None = None
    number: int = -1

    def best_split(self) -> tuple[int, str]:
        """(NULLs spared at least, attribute) of parting the group; (0, "") if all its entities have all its columns."""
        return max(((self.n - c, a) for a, c in self.columns.items() if c < self.n), default=(0, ""))

    def leaves(self) -> list[Group]:
        return [self] if self.split is None else self.has.leaves() + self.lacks.leaves()

    def place(self, sig: Column) -> Column:
        """The number of the group of a set."""
        if self.split is None:
            return F.lit(self.number)
        return F.when(F.array_contains(sig, self.split), self.has.place(sig)).otherwise(self.lacks.place(sig))


def merged_sets(known: DataFrame, max_tables: int, max_columns: int) -> Group:
    """The tree of at most max_tables groups of sets. A level of it is one aggregate of the sets' counts."""
    sets = materialise(known.groupBy("sig").count())
    root = Group(number=0)
    fresh = [root]
    while fresh:
        numbers = {g.number for g in fresh}
        placed = sets.select("sig", "count", root.place(F.col("sig")).alias("g")).where(F.col("g").isin(*numbers))
        per = placed.select("g", "count", F.explode(F.concat(F.array(F.lit(None).cast("string")), "sig")).alias("a")).groupBy("g", "a").agg(F.sum("count").alias("n"))
        rows = per.limit(max_tables * (max_columns + 1) + 1).collect()
        if len({r.a for r in rows}) > max_columns + 1:
            raise ValueError(f"more than {max_columns} attributes")
        for r in rows:
            group = next(g for g in fresh if g.number == r.g)
            if r.a is None:
                group.n = r.n
            else:
                group.columns[r.a] = r.n
        leaves = root.leaves()
        gains = sorted(((*g.best_split(), g) for g in leaves if g.best_split()[0]), key=lambda x: (-x[0], x[1], x[2].number))
        fresh = []
        for _, attribute, group in gains[: max_tables - len(leaves)]:
            group.split = attribute
            group.has, group.lacks = Group(number=group.number), Group(number=len(leaves) + len(fresh) // 2)
            fresh += [group.has, group.lacks]
    return root


def wide_table(cells: DataFrame, entity: str = "entity", max_tables: int = 8, max_columns: int = 2000) -> tuple[DataFrame, dict[str, str]]:
    """(one row per entity with a typed column per attribute, attribute -> kind).

    cells: entity, attribute, kind, q, m, c, at, tie. Defined results: an empty input gives a table with the entity column
    only; repeated rows and ties in `at` are settled by `tie`, then by the greater value; an attribute named as the entity
    column raises ValueError, as do more than max_columns attributes (a bound on the schema that the driver collects).
    """
    known = materialise(characteristic_sets(latest_cells(cells)))
    kinds = _kinds(known, max_columns)
    if entity in kinds:
        raise ValueError(f"an attribute is named as the entity column: {entity}")
    tree = merged_sets(known, max_tables, max_columns)
    rows = materialise(known.withColumn("group", tree.place(F.col("sig"))), by=("group",)).withColumnRenamed("entity", entity)
    tables = [_dense(rows.where(F.col("group") == g.number), entity, sorted(g.columns), kinds) for g in tree.leaves()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.select(f"`{entity}`", *(f"`{n}`" for n in sorted(kinds))), kinds


def _kinds(known: DataFrame, max_columns: int) -> dict[str, str]:
    """attribute -> kind over all entities; the distinct names are bounded by max_columns."""
    per_kind = [known.select(F.explode(F.map_keys(m)).alias("name"), F.lit(k).alias("kind")) for m, k in (("qs", QUANTITY), ("ms", MEASURE), ("cs", CLASSIFICATION))]
    found = per_kind[0].union(per_kind[1]).union(per_kind[2]).distinct().limit(max_columns + 1).collect()
    if len(found) > max_columns:
        raise ValueError(f"more than {max_columns} attributes")
    return {r.name: r.kind for r in found}


def _dense(rows: DataFrame, entity: str, names: Sequence[str], kinds: Mapping[str, str]) -> DataFrame:
    maps = {QUANTITY: "qs", MEASURE: "ms", CLASSIFICATION: "cs"}
    return rows.select(f"`{entity}`", *(F.try_element_at(F.col(maps[kinds[n]]), F.lit(n)).alias(n) for n in names))


def melt_cells(wide: DataFrame, entity: str, kinds: Mapping[str, str]) -> DataFrame:
    """(entity, metric, cell_value) of every non-empty cell: plain digits, three decimals, or the text."""

    def text(name: str) -> Column:
        c = F.col(f"`{name}`")
        return F.format_string("%.3f", c) if kinds[name] == MEASURE else c.cast("string")

    cells = [F.when(F.col(f"`{n}`").isNotNull(), F.struct(F.lit(n).alias("metric"), text(n).alias("cell_value"))) for n in sorted(kinds)]
    if not cells:
        return wide.select(F.col(f"`{entity}`").alias(entity), F.lit("").alias("metric"), F.lit("").alias("cell_value")).limit(0)
    return wide.select(F.col(f"`{entity}`").alias(entity), F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("v")).select(entity, "v.metric", "v.cell_value")
