"""Bars as unbounded streams: the batch semantics with watermarks and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.schema import BARS, SERIES, later, seconds


def read_bars(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(BARS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def watermarked(bars: DataFrame, late: str | None) -> DataFrame:
    """late None: the stream has its watermark already, for it can be set once only."""
    return bars.withWatermark("timestamp_open_utc", late) if late else bars


def tumbling_ohlc(bars: DataFrame, timeframe: str, base: str = "1min", late: str | None = "10 minutes") -> DataFrame:
    """Dense, complete windows, each emitted once, when the watermark has passed its end (append mode)."""
    need = seconds(timeframe) // seconds(base)
    at = F.col("timestamp_open_utc")
    w = F.window(at, f"{seconds(timeframe)} seconds").alias("w")
    grouped = watermarked(bars, late).groupBy(*SERIES, w).agg(
        F.min_by("bid_open", at).alias("bid_open"), F.max("bid_high").alias("bid_high"), F.min("bid_low").alias("bid_low"), F.max_by("bid_close", at).alias("bid_close"),
        F.bool_and("is_complete").alias("is_complete"), F.count("*").alias("n_bars"), F.min(at).alias("first_open"), F.max(at).alias("last_open"),
    )
    dense = (F.col("n_bars") == need) & (F.col("first_open") == F.col("w.start")) & (F.col("last_open") == later(F.col("w.end"), -(seconds(base) // 60))) & F.col("is_complete")
    return grouped.filter(dense).select(*SERIES, F.col("w.start").alias("timestamp_open_utc"), F.col("w.end").alias("timestamp_close_utc"), "bid_open", "bid_high", "bid_low", "bid_close")


def without_repeats(bars: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Identical re-deliveries within the watermark are dropped; state is forgotten after it."""
    return bars.withWatermark("timestamp_open_utc", late).dropDuplicatesWithinWatermark([*SERIES, "timestamp_open_utc", "bid_open", "bid_high", "bid_low", "bid_close"])


def sessions(bars: DataFrame, cadence: str = "60 seconds", late: str | None = "10 minutes") -> DataFrame:
    """Contiguous runs as session windows: touching bars of one cadence merge."""
    w = F.session_window("timestamp_open_utc", cadence).alias("w")
    return watermarked(bars, late).groupBy(*SERIES, w).agg(F.count("*").alias("n")).select(*SERIES, F.col("w.start").alias("start_utc"), F.col("w.end").alias("end_utc"), "n")


def asof_stream(left: DataFrame, right: DataFrame, tolerance_minutes: int, names: list[str], late: str = "10 minutes") -> DataFrame:
    """Left rows with every right row at most tolerance old, as the batch join has it: an interval join with bounded state. The latest one is chosen by
    a window in foreachBatch, or by taking right bars that stand on the grid, of which only one can match."""
    a = left.withWatermark("prediction_time_utc", late)
    b = right.withWatermark("available_at_utc", late).select(*[F.col(c).alias(f"r_{c}") for c in SERIES], "available_at_utc", *names)
    fresh = (F.col("available_at_utc") <= F.col("prediction_time_utc")) & (F.col("available_at_utc") >= F.col("prediction_time_utc") - F.expr(f"INTERVAL {tolerance_minutes} MINUTES"))
    same = (F.col("instrument") == F.col("r_instrument")) & (F.col("source") == F.col("r_source"))
    return a.join(b, same & fresh, "leftOuter").drop("r_instrument", "r_source")


def _positions(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    until = state.get[0] if state.exists else -1
    rows = pd.concat(list(frames)).sort_values(["prediction_us", "horizon_minutes"], kind="stable")
    taken = []
    for entry, end in zip(rows["entry_us"], rows["end_us"], strict=True):
        taken.append(bool(entry >= until))
        until = int(end) if taken[-1] else until
    state.update((until,))
    yield pd.DataFrame({"instrument": key[0], "prediction_us": rows["prediction_us"], "horizon_minutes": rows["horizon_minutes"], "executed": taken})


def positions(signals: DataFrame) -> DataFrame:
    """Signals with executed: the state of an instrument is one number, the end of its open position."""
    us = lambda c: F.unix_micros(c)
    flat = signals.select("instrument", us("prediction_time_utc").alias("prediction_us"), us("entry_time_utc").alias("entry_us"), us("label_end_time_utc").alias("end_us"), "horizon_minutes")
    out = flat.groupBy("instrument").applyInPandasWithState(_positions, "instrument string, prediction_us long, horizon_minutes int, executed boolean", "until long", "append", GroupStateTimeout.NoTimeout)
    return out.select("instrument", F.timestamp_micros("prediction_us").alias("prediction_time_utc"), "horizon_minutes", "executed")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Process what is there, once; a second run with the same checkpoint takes up only what is new."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
