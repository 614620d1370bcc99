"""Contiguous runs of bars, found without one window over a whole series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.schema import SERIES

OPEN = "timestamp_open_utc"


def days_together(bars: DataFrame) -> DataFrame:
    """bars with each series' day in one partition: of a table written so, each scan holds whole windows, and partial sums gather them before an exchange."""
    return bars.repartition(*SERIES, F.to_date(OPEN))


def with_segments(bars: DataFrame, cadence_seconds: int, time: str = OPEN, positions: bool = False) -> DataFrame:
    """Add seg, the opening time of the run that a bar belongs to (a new run starts where the distance to the bar before is
    not the cadence), and with positions seg_pos, its place in it from 0.

    Breaks are found within days; only a row a day is carried across days, so a series of any length is spread over
    tasks. A run has no gap, so a bar's position is its distance from the start in cadences.
    """
    day = F.to_date(time)
    within = Window.partitionBy(*SERIES, "_day").orderBy(time)
    marked = bars.withColumn("_day", day).withColumn("_prev", F.lag(time).over(within))
    gap = F.unix_micros(time) - F.unix_micros("_prev") != F.lit(cadence_seconds * 1_000_000)
    inner = marked.withColumn("_break", F.when(gap, F.col(time)))
    days = inner.groupBy(*SERIES, "_day").agg(F.min(time).alias("_first"), F.max(time).alias("_last"), F.max("_break").alias("_latest"))
    across = Window.partitionBy(*SERIES).orderBy("_day")
    before = F.lag("_last").over(across)
    opens = before.isNull() | (F.unix_micros("_first") - F.unix_micros(before) != F.lit(cadence_seconds * 1_000_000))
    days = days.withColumn("_head", F.when(opens, F.col("_first")))
    carried = F.last(F.coalesce("_latest", "_head"), ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(*SERIES, "_day", F.coalesce("_head", carried).alias("_start"))
    latest = F.last("_break", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    out = inner.withColumn("_in", latest).join(days, [*SERIES, "_day"]).withColumn("seg", F.coalesce("_in", "_start")).drop("_day", "_prev", "_break", "_in", "_start")
    return out.withColumn("seg_pos", ((F.unix_seconds(time) - F.unix_seconds("seg")) / cadence_seconds).cast("long")) if positions else out


def within_segment(time: str = OPEN):
    return Window.partitionBy(*SERIES, "seg").orderBy(time)
