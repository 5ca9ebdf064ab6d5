"""Activity as it comes in: windows and sessions over a stream of events with late rows.

The batch operators see the whole history; these are the streaming counterparts, with a watermark that bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, at: str, key: str, window: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(started, ended, key, events): rows later than the watermark are dropped; empty windows don't appear."""
    grouped = events.withWatermark(at, late).groupBy(F.window(at, window, slide or window).alias("w"), F.col(key))
    return grouped.agg(F.count("*").alias("events")).select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), key, "events")


def session_counts(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, started, ended, events): ended is the last event's time plus the gap; a gap of exactly that length ends a session."""
    grouped = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), F.col(key))
    return grouped.agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def latest_touch(touches: DataFrame, late: str = "1 day") -> DataFrame:
    """touches without repeats of a touch_id within the watermark."""
    return touches.withWatermark("touched_at", late).dropDuplicatesWithinWatermark(["touch_id"])
