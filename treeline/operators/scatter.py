"""Scatter data: rows with all coordinates, extents, positions on linear, logarithmic and banded axes, radii, ticks."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Margins around the plot and sizes of discs.
TOP, RIGHT, BOTTOM, LEFT = 48.0, 32.0, 96.0, 96.0
MIN_RADIUS, RADIUS_SHARE = 12.0, 0.45
MIN_SLOTS = 8.0


@dataclass(frozen=True)
class Plot:
    x: float
    y: float
    w: float
    h: float


def plot_area(width: float, height: float) -> Plot:
    return Plot(LEFT, TOP, max(1.0, width - LEFT - RIGHT), max(1.0, height - TOP - BOTTOM))


def coalesced(quantity: Column, measure: Column) -> Column:
    """A value of either kind as a number, the quantity first."""
    return F.coalesce(quantity.cast("double"), measure.cast("double"))


def dataset(rows: DataFrame, x: str, y: str, size: str) -> DataFrame:
    """The rows that have all three coordinates."""
    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(size).isNotNull())


def skipped(rows: DataFrame, x: str, y: str, size: str) -> DataFrame:
    """One row: how many rows lack each coordinate (a row may count thrice) and how many are kept."""
    lacks = {n: F.col(c).isNull() for n, c in (("missing_x", x), ("missing_y", y), ("missing_size", size))}
    kept = F.count_if(~(lacks["missing_x"] | lacks["missing_y"] | lacks["missing_size"]))
    return rows.agg(*(F.count_if(c).alias(n) for n, c in lacks.items()), kept.alias("kept"))


def extent(rows: DataFrame, **columns: str) -> DataFrame:
    """One row: lo_<name>, hi_<name> of each column."""
    return rows.agg(*(f(F.col(c)).alias(f"{p}_{n}") for n, c in columns.items() for p, f in (("lo", F.min), ("hi", F.max))))


def require_positive(rows: DataFrame, *columns: str) -> DataFrame:
    """rows; raises ValueError naming every column that a logarithmic axis can't show."""
    low = rows.agg(*(F.min(c).alias(c) for c in columns)).first()
    bad = [c for c in columns if low[c] is not None and low[c] <= 0]
    if bad:
        raise ValueError(f"not positive throughout: {', '.join(bad)}")
    return rows


def linear(v: Column, lo: Column, hi: Column) -> Column:
    """0 at the low end, 1 at the high end, the middle if both are one."""
    return F.when(lo == hi, F.lit(0.5)).otherwise((v - lo) / (hi - lo))


def logarithmic(v: Column, lo: Column, hi: Column) -> Column:
    return F.when(lo == hi, F.lit(0.5)).otherwise((F.log(v) - F.log(lo)) / (F.log(hi) - F.log(lo)))


def across(norm: Column, plot: Plot) -> Column:
    return F.lit(plot.x) + F.lit(plot.w) * norm


def up(norm: Column, plot: Plot) -> Column:
    return F.lit(plot.y) + F.lit(plot.h) * (1 - norm)


def radius(v: Column, lo: Column, hi: Column, largest: Column) -> Column:
    return F.when((largest <= MIN_RADIUS) | (lo == hi), largest).otherwise(F.lit(MIN_RADIUS) + (largest - MIN_RADIUS) * (v - lo) / (hi - lo))


def largest_radius(slot_w: Column, slot_h: Column) -> Column:
    """The radius of the largest disc for the size of an axis slot."""
    return F.greatest(F.lit(MIN_RADIUS), F.greatest(F.lit(4.0), F.least(slot_w, slot_h) * RADIUS_SHARE))


def slot(span: float, points: Column) -> Column:
    """The room for a point on a numeric axis."""
    return F.lit(span) / F.greatest(F.lit(MIN_SLOTS), F.sqrt(F.greatest(points, F.lit(1)).cast("double")))


def bands(rows: DataFrame, category: str, origin: float, span: float) -> DataFrame:
    """(label, started, ended, center): equal bands in order of the labels."""
    labels = rows.where(F.col(category).isNotNull()).select(F.col(category).alias("label")).distinct()
    place = F.row_number().over(Window.orderBy("label")) - 1
    size = F.lit(span) / F.count("*").over(Window.partitionBy())
    start = F.lit(origin) + F.col("place") * F.col("size")
    return labels.withColumn("place", place).withColumn("size", size).select("label", start.alias("started"), (start + F.col("size")).alias("ended"), (start + F.col("size") / 2).alias("center"))


def ticks(lo: float, hi: float) -> list[float]:
    """Four to ten even gaps of a round size around an extent, seven if that can be; an end near zero reaches to it."""
    if lo == hi:
        return [lo]
    near = (hi - lo) * 0.2
    lo, hi = (0.0 if 0 < lo <= near else lo), (0.0 if 0 < -hi <= near else hi)
    power = math.floor(math.log10((hi - lo) / 7))
    options = []
    for step in (a * 10.0**p for p in range(power - 1, power + 2) for a in (1, 2, 2.5, 5, 10)):
        first, last = math.floor(lo / step), math.ceil(hi / step)
        if 4 <= last - first <= 10:
            slack = (lo / step - first) + (last - hi / step)
            options.append((abs(last - first - 7), first - last, slack, step, first, last))
    if not options:
        return [lo + (hi - lo) * k / 7 for k in range(8)]
    *_, step, first, last = min(options)
    return [k * step for k in range(first, last + 1)]


def log_ticks(lo: float, hi: float) -> list[float]:
    """Powers of ten within an extent; if they are few also their doubles and fivefolds; if still few five even steps of the logarithm."""
    if lo == hi:
        return [lo]
    powers = [10.0**p for p in range(math.floor(math.log10(lo)), math.ceil(math.log10(hi)) + 1)]
    for factors in ((1,), (1, 2, 5)):
        inside = [v for p in powers for f in factors if lo <= (v := f * p) <= hi]
        if len(inside) >= 4:
            return inside
    return [lo * (hi / lo) ** (k / 4) for k in range(5)]


def tick_label(value: float, step: float) -> str:
    """value with as many decimals, six at most, as its step needs; six significant figures without a step."""
    if step <= 0:
        return f"{value:.6g}"
    decimals = next((d for d in range(6) if abs(step * 10**d - round(step * 10**d)) < 1e-9), 6)
    return f"{value:.{decimals}f}"
