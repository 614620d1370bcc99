"""Bars to longer bars: dense windows that are closed and complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.schema import REQUIRED, SERIES, floor_to, later, seconds, window_end


def lineage(name: str) -> Column:
    """The one value of a window's bars, or a hash of the sorted different ones."""
    values = F.array_sort(F.collect_set(name))
    return F.when(F.size(values) == 1, values[0]).otherwise(F.concat(F.lit("sha256:"), F.sha2(F.array_join(values, "\n"), 256)))


def windows(bars: DataFrame, timeframe: str) -> DataFrame:
    """OHLC of every window that has bars, with what is needed to judge it. First and last are by time, in one aggregation
    with partial sums, so that a window is never sorted or gathered."""
    at = F.col("timestamp_open_utc")
    return bars.groupBy(*SERIES, floor_to(at, timeframe).alias("window_open")).agg(
        F.min_by("bid_open", at).alias("bid_open"), F.max("bid_high").alias("bid_high"), F.min("bid_low").alias("bid_low"), F.max_by("bid_close", at).alias("bid_close"),
        F.bool_and("is_complete").alias("is_complete"), F.max("ingested_at_utc").alias("ingested_at_utc"), lineage("raw_file_hash").alias("raw_file_hash"), lineage("dataset_version").alias("dataset_version"),
        F.count("*").alias("n_bars"), F.min(at).alias("first_open"), F.max(at).alias("last_open"),
    ).withColumn("window_close", window_end(F.col("window_open"), timeframe))


def expected_bars(base: str) -> Column:
    return ((F.unix_seconds("window_close") - F.unix_seconds("window_open")) / seconds(base)).cast("long")


def dense(base: str) -> Column:
    return (F.col("n_bars") == expected_bars(base)) & (F.col("first_open") == F.col("window_open")) & (F.col("last_open") == later(F.col("window_close"), -(seconds(base) // 60)))


def resample(bars: DataFrame, timeframe: str, base: str = "1min", closed_through: Column | None = None, closed_minutes: DataFrame | None = None) -> DataFrame:
    """Longer bars of windows that are complete, closed and dense.

    closed_through: windows that end later are left out; by default what each series was last ingested. closed_minutes: a
    table (instrument, source, timestamp_open_utc) of base bars that the calendar says are closed; a window whose missing
    bars are all among them counts as dense too.
    """
    found = windows(bars, timeframe)
    if closed_through is None:
        limits = bars.groupBy(*SERIES).agg(F.max("ingested_at_utc").alias("closed_through"))
        found = found.join(limits, SERIES).filter("window_close <= closed_through").drop("closed_through")
    else:
        found = found.filter(F.col("window_close") <= closed_through)
    ok = dense(base)
    if closed_minutes is not None:
        shut = closed_minutes.join(bars.select(*SERIES, "timestamp_open_utc"), [*SERIES, "timestamp_open_utc"], "left_anti").groupBy(*SERIES, floor_to(F.col("timestamp_open_utc"), timeframe).alias("window_open")).agg(F.count("*").alias("n_shut"))
        found = found.join(shut, [*SERIES, "window_open"], "left")
        ok = ok | (F.col("n_bars") + F.coalesce("n_shut", F.lit(0)) == expected_bars(base))
    kept = found.filter(F.col("is_complete") & ok)
    return kept.withColumn("timeframe", F.lit(timeframe)).withColumnsRenamed({"window_open": "timestamp_open_utc", "window_close": "timestamp_close_utc"}).select(*REQUIRED)


def resample_many(bars: DataFrame, timeframes: list[str], base: str = "1min") -> DataFrame:
    """Several timeframes from one source in one table."""
    parts = [resample(bars, t, base) for t in timeframes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
