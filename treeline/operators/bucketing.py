"""Quantile buckets of values, colours for buckets and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.session import materialise

# The palettes, from the low to the high end.
PALETTES = {
    "neutral": "#000000 #202020 #404040 #606060 #808080 #a0a0a0 #c0c0c0 #e0e0e0 #ffffff",
    "categorization": "#a6cee3 #1f78b4 #b2df8a #33a02c #fb9a99 #e31a1c #fdbf6f #ff7f00 #cab2d6 #6a3d9a #ffff99 #b15928",
    "temperature": "#053061 #2166ac #4393c3 #92c5de #d1e5f0 #f7f7f7 #fddbc7 #f4a582 #d6604d #b2182b #67001f",
    "good-bad": "#a50026 #d73027 #f46d43 #fdae61 #fee08b #ffffbf #ffffff #d9ef8b #a6d96a #66bd63 #1a9850 #006837 #00441b",
    "foliage": "#0f0a05 #2d190a #552d0f #824614 #af5f19 #d2821e #e6af28 #f0d732 #a5c832 #50a528 #197814",
    "terrain": "#1a5276 #5dade2 #f4d03f #82e0aa #52be80 #1e8449 #6e2c00 #f0f3f4",
}
UNORDERED = ("categorization",)
GREY, BLACK, WHITE = "#808080", "#000000", "#ffffff"


def colours(palette: str) -> list[str]:
    return PALETTES.get(palette, "").split()


def palette_for(metric_palette: str | None, explicit: str | None = None) -> str:
    """The palette asked for, else the metric's own, else neutral."""
    return explicit or metric_palette or "neutral"


def significant(v: Column, figures: int = 2) -> Column:
    """v rounded to so many significant figures, halves away from zero."""
    power = F.pow(F.lit(10.0), F.lit(float(figures)) - F.ceil(F.log10(F.abs(v))))
    return F.when(v == 0, F.lit(0.0)).otherwise(F.round(v * power) / power)


def boundaries(values: DataFrame, value: str, steps: int) -> DataFrame:
    """One row (boundaries, min, max, n): the sorted values at places i*n/steps, rounded, each once, those <= min dropped.

    The exact value at a place comes from the running count over distinct values, of which the range-partitioned counts are
    summed per partition first: no single task sorts all rows. The ranges are written, so that all readings see the same ones.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    sliced = materialise(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    per = sliced.groupBy("part").agg(F.sum("c").alias("size"))
    before = per.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    within = F.sum("c").over(Window.partitionBy("part").orderBy("v"))
    upto = sliced.join(F.broadcast(before), "part").withColumn("upto", F.col("before") + within).withColumn("from", F.col("upto") - F.col("c"))
    ends = sliced.agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    places = ends.select("n", "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(max(steps - 1, 1)))).alias("i")).withColumn("place", F.floor(F.col("i") * F.col("n") / F.lit(steps)).cast("bigint"))
    hit = F.broadcast(places).join(upto, (F.col("place") >= F.col("from")) & (F.col("place") < F.col("upto")))
    found = hit.where((F.col("lo") < F.col("hi")) & F.lit(steps > 1)).agg(F.array_sort(F.collect_set(significant(F.col("v")))).alias("b"))
    rounded = F.coalesce("b", F.array().cast("array<double>"))
    return ends.crossJoin(F.broadcast(found)).select(F.filter(rounded, lambda x: x > F.col("lo")).alias("boundaries"), F.col("lo").alias("min"), F.col("hi").alias("max"), "n")


def bucket_index(v: Column, bounds: Column) -> Column:
    """How many boundaries a value has reached."""
    return F.size(F.filter(bounds, lambda b: v >= b))


def colour_of(index: Column, bounds: Column, palette: str) -> Column:
    """The palette's colour of a bucket: the buckets are spread over the palette; the middle if there is one bucket."""
    names = colours(palette)
    table = F.array(*map(F.lit, names or [BLACK]))
    n = F.size(bounds) + 1
    place = F.when(n <= 1, F.lit(len(names) // 2)).otherwise(F.floor(index * (len(names) - 1) / (n - 1)))
    return F.element_at(table, (F.least(place, F.lit(max(len(names) - 1, 0))) + 1).cast("int"))


def category_colours(values: DataFrame, category: str, palette: str = "categorization") -> DataFrame:
    """(category, place, colour) of the distinct categories in order; beyond the palette's end it starts again."""
    names = colours(palette) or [GREY]
    place = F.row_number().over(Window.orderBy("category")) - 1
    distinct = values.where(F.col(category).isNotNull()).select(F.col(category).alias("category")).distinct()
    return distinct.withColumn("place", place).withColumn("colour", F.element_at(F.array(*map(F.lit, names)), (F.pmod("place", F.lit(len(names))) + 1).cast("int")))


def coloured(rows: DataFrame, category: str, table: DataFrame) -> DataFrame:
    """rows with colour; a category that the table doesn't have is grey."""
    return rows.join(table.select(F.col("category").alias(category), "colour"), category, "left").withColumn("colour", F.coalesce("colour", F.lit(GREY)))


def luminance(colour: Column) -> Column:
    """Relative luminance of #rrggbb."""

    def channel(at: int) -> Column:
        v = F.conv(F.substring(colour, at, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(2) + 0.7152 * channel(4) + 0.0722 * channel(6)


def contrast(a: Column, b: Column) -> Column:
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def text_colour(colour: Column) -> Column:
    return F.when(luminance(colour) > 0.5, BLACK).otherwise(WHITE)


def darkened(colour: Column, share: float = 0.4) -> Column:
    """colour with each channel reduced by a share."""
    parts = [F.lpad(F.lower(F.hex(F.floor(F.conv(F.substring(colour, at, 2), 16, 10).cast("double") * (1 - share)).cast("bigint"))), 2, "0") for at in (2, 4, 6)]
    return F.concat(F.lit("#"), *parts)
