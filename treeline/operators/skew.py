"""Distinct counts per key when a few keys hold most of the rows.

Heavy keys are found with a frequent-items sketch. Their rows take a path of their own: marked by a broadcast join against
the (bounded) list of heavy keys, deduplicated by a shuffle on (key, value), so no task ever holds a heavy key whole, and
counted from partial counts. All other keys need only one ordinary shuffle on the key. The two results are unioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.session import materialise

#: A key is heavy from this share of the rows on; there can be no more than 1/share such keys, so their list is bounded.
HEAVY_SHARE = 0.005


def heavy_keys(rows: DataFrame, keys: Sequence[str], share: float = HEAVY_SHARE) -> DataFrame:
    """The keys that hold at least `share` of the rows (by an upper estimate), at most ceil(2/share) rows.

    One pass over the key columns; each task keeps a sketch of bounded size and only sketches are shuffled. The sketch never
    misses a key above the share and may name one that lies just below it, which changes the path such a key takes but not
    its result. Its size follows from the share, of which it takes 0.0001 and more.
    """
    if not 0.0001 <= share <= 1:
        raise ValueError(f"share {share} is not between 0.0001 and 1")
    k = int(2 / share) + 1
    key = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keys)))
    sketch = rows.select(key.alias("key")).agg(F.count("*").alias("n"), F.expr(f"approx_top_k(to_json(key), {k}, {20 * k})").alias("top"))
    found = sketch.select("n", F.explode("top").alias("t")).where(F.col("t.count") >= F.greatest(F.lit(2), share * F.col("n")))
    ddl = ", ".join(f"k{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(keys))
    parsed = found.select(F.from_json("t.item", ddl).alias("key"))
    return parsed.select(*(F.col(f"key.k{i}").alias(c) for i, c in enumerate(keys)))


def distinct_counts(rows: DataFrame, keys: Sequence[str], values: Sequence[str], share: float = HEAVY_SHARE) -> DataFrame:
    """keys, n_<value>...: the number of distinct values of each key in each value column, evenly spread over the tasks.

    NULL keys form no group; NULL values aren't counted (a key with NULL values only has 0). Repeated rows count once;
    an empty input gives an empty result; columns other than keys and values are ignored. The rows are written once, since
    the sketch, the heavy and the light branch each read them.
    """
    keys, values = list(keys), list(values)
    rows = materialise(rows.select(*keys, *values).where(" AND ".join(f"`{c}` IS NOT NULL" for c in keys)))
    heavy = F.broadcast(materialise(heavy_keys(rows, keys, share)))  # at most ceil(2/share) rows
    as_bytes = {v: F.col(v) if rows.schema[v].dataType.simpleString() == "binary" else F.col(v).cast("string").cast("binary") for v in values}
    which = F.array(*(F.struct(F.lit(i).alias("i"), as_bytes[v].alias("v")) for i, v in enumerate(values)))

    def counted(part: DataFrame) -> DataFrame:
        pairs = part.select(*keys, F.explode(which).alias("_f")).select(*keys, "_f.i", "_f.v").distinct()
        return pairs.groupBy(*keys).agg(*(F.count(F.when(F.col("i") == i, F.col("v"))).alias(f"n_{v}") for i, v in enumerate(values)))

    # a heavy key's pairs are shuffled on (key, value), repeats having met in the task that reads them; a light key's rows
    # are shuffled once on the key, under which all else stays
    of_heavy = counted(rows.join(heavy, keys, "left_semi"))
    of_light = counted(rows.join(heavy, keys, "left_anti").repartition(*keys))
    return of_heavy.unionByName(of_light)
