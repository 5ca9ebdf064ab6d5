"""A contiguous grid of hours or days over the events' time, empty buckets kept, and what falls into each bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESOLUTIONS = {"hourly": ("HOUR", "INTERVAL 1 HOUR", 24), "daily": ("DAY", "INTERVAL 1 DAY", 28)}


def bucket_start(at: Column, resolution: str = "daily") -> Column:
    """The start of the bucket that holds a moment: a key for an equality join, never a range join."""
    return F.date_trunc(RESOLUTIONS[resolution][0], at).cast("timestamp_ntz")


def grid(events: DataFrame, at: str, resolution: str = "daily") -> DataFrame:
    """(bucket, started): buckets from that of the first event for as long as they start before the last event.

    So an event exactly at the last moment, if a bucket starts there, is in none; and events at one moment only make no grid.
    """
    unit, step, _ = RESOLUTIONS[resolution]
    ends = events.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).where("lo < hi")
    last = F.expr("hi - INTERVAL 1 MICROSECOND")
    starts = F.sequence(F.date_trunc(unit, "lo").cast("timestamp_ntz"), F.date_trunc(unit, last).cast("timestamp_ntz"), F.expr(step))
    return ends.select(F.posexplode(starts).alias("bucket", "started"))


def assigned(events: DataFrame, at: str, resolution: str = "daily") -> DataFrame:
    """events with bucket and started; those outside the grid are left out."""
    keyed = events.withColumn("started", bucket_start(F.col(at), resolution))
    return keyed.join(F.broadcast(grid(events, at, resolution)), "started")


def bucket_counts(events: DataFrame, at: str, resolution: str = "daily") -> DataFrame:
    """(bucket, started, events): 0 for an empty bucket."""
    per = events.groupBy(bucket_start(F.col(at), resolution).alias("started")).agg(F.count("*").alias("events"))
    return grid(events, at, resolution).join(per, "started", "left").select("bucket", "started", F.coalesce("events", F.lit(0)).alias("events"))


def bucket_sums(events: DataFrame, at: str, file: str, value: str, resolution: str = "daily") -> DataFrame:
    """(bucket, started, value): the sum over the distinct files of a bucket; NULL without any value."""
    once = events.groupBy(bucket_start(F.col(at), resolution).alias("started"), file).agg(F.max(value).alias("v"))
    per = once.groupBy("started").agg(F.sum("v").alias("value"))
    return grid(events, at, resolution).join(per, "started", "left").select("bucket", "started", "value")


def bucket_modes(events: DataFrame, at: str, category: str, resolution: str = "daily") -> DataFrame:
    """(bucket, started, category): the most frequent category per event, ties to the smallest; '' without any."""
    counts = events.where(F.col(category).isNotNull()).groupBy(bucket_start(F.col(at), resolution).alias("started"), F.col(category).alias("c")).agg(F.count("*").alias("n"))
    per = counts.groupBy("started").agg(F.min_by("c", F.struct(-F.col("n"), F.col("c"))).alias("category"))
    return grid(events, at, resolution).join(per, "started", "left").select("bucket", "started", F.coalesce("category", F.lit("")).alias("category"))
