"""Bars from the events table: a dense minute clock, and real ticks gathered to bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.schema import REQUIRED, floor_to, later, window_end

EPOCH = 1_704_067_200  # 2024-01-01 in UTC


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def ingested(close: Column) -> Column:
    """When a bar was ingested: a fixed time, but never before the bar's close."""
    return F.greatest(F.lit("2026-01-01").cast("timestamp"), close)


def minute_clocks(raw: DataFrame, values: dict[str, str]) -> DataFrame:
    """For each instrument and its value one bar a minute from event_id: it opens on an event's value and closes on the next one's.

    The next event is found by joining on event_id + 1, once for all instruments, not by a window over the whole table. Two rules
    take bars out, so that the series has short and long gaps.
    """
    names = [f"v{k}" for k in range(len(values))]
    one = raw.select("event_id", *[F.expr(v).cast("double").alias(n) for n, v in zip(names, values.values(), strict=True)])
    following = one.select((F.col("event_id") - 1).alias("event_id"), *[F.col(n).alias(f"next_{n}") for n in names])
    i, opened, closed = F.col("event_id"), 2000 + 0.05 * F.col("v"), 2000 + 0.05 * F.col("next_v")
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("instrument"), F.col(n).alias("v"), F.col(f"next_{n}").alias("next_v")) for k, n in zip(values, names, strict=True)]))
    kept = one.join(following, "event_id").filter((i % 997 != 500) & ~(i % 5000).between(2000, 2180)).select("event_id", each)
    opens = F.timestamp_seconds(F.lit(EPOCH) + i * 60)
    return kept.select(
        "instrument", F.lit("clock").alias("source"), F.lit("1min").alias("timeframe"),
        opens.alias("timestamp_open_utc"), later(opens, 1).alias("timestamp_close_utc"),
        opened.alias("bid_open"), (F.greatest(opened, closed) + 0.01 * (i % 7)).alias("bid_high"),
        (F.least(opened, closed) - 0.01 * (i % 5)).alias("bid_low"), closed.alias("bid_close"),
        F.lit(True).alias("is_complete"), F.concat(F.lit("file"), (F.floor(i / 1000)).cast("string")).alias("raw_file_hash"),
        ingested(later(opens, 1)).alias("ingested_at_utc"), F.lit("v1").alias("dataset_version"),
    ).select(*REQUIRED)


def minute_clock(raw: DataFrame, value: str = "value", instrument: str = "CLOCK_A") -> DataFrame:
    """One instrument on the minute clock."""
    return minute_clocks(raw, {instrument: value})


def both_clocks(raw: DataFrame) -> DataFrame:
    """Two instruments on the minute clock."""
    return minute_clocks(raw, {"CLOCK_A": "value", "CLOCK_B": "user_id % 100"})


def tick_bars(raw: DataFrame, timeframe: str = "1h") -> DataFrame:
    """Bars of real ticks, an instrument for each event type; ties in time are broken by event_id."""
    ticks = raw.select(F.col("event_type").alias("instrument"), floor_to(F.col("ts").cast("timestamp"), timeframe).alias("timestamp_open_utc"), F.struct("ts", "event_id").alias("at"), (2000 + 0.05 * F.col("value")).alias("p"))
    bars = ticks.groupBy("instrument", "timestamp_open_utc").agg(F.min_by("p", "at").alias("bid_open"), F.max("p").alias("bid_high"), F.min("p").alias("bid_low"), F.max_by("p", "at").alias("bid_close"))
    return bars.withColumns(
        {"source": F.lit("ticks"), "timeframe": F.lit(timeframe), "timestamp_close_utc": window_end(F.col("timestamp_open_utc"), timeframe), "is_complete": F.lit(True), "raw_file_hash": F.lit("ticks"), "ingested_at_utc": ingested(window_end(F.col("timestamp_open_utc"), timeframe)), "dataset_version": F.lit("v1")}
    ).select(*REQUIRED)
