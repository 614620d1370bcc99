"""The bar table: names, types, timeframes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["instrument", "timeframe", "timestamp_open_utc", "source"]
SERIES = ["instrument", "source"]
PRICES = ["bid_open", "bid_high", "bid_low", "bid_close"]
LINEAGE = ["raw_file_hash", "ingested_at_utc", "dataset_version"]

BARS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("instrument", "source", "timeframe")]
    + [T.StructField(c, T.TimestampType()) for c in ("timestamp_open_utc", "timestamp_close_utc")]
    + [T.StructField(c, T.DoubleType()) for c in PRICES]
    + [T.StructField("is_complete", T.BooleanType()), T.StructField("raw_file_hash", T.StringType()), T.StructField("ingested_at_utc", T.TimestampType()), T.StructField("dataset_version", T.StringType())]
)
REQUIRED = BARS.names

# Minutes of each timeframe; months follow the calendar.
MINUTES = {"1min": 1, "3min": 3, "5min": 5, "15min": 15, "30min": 30, "1h": 60, "3h": 180, "1d": 1440}
TIMEFRAMES = [*MINUTES, "1mo"]


def seconds(timeframe: str) -> int:
    if timeframe not in MINUTES:
        raise ValueError(f"{timeframe!r} has no fixed length; known are {', '.join(MINUTES)}")
    return MINUTES[timeframe] * 60


def floor_to(ts: Column, timeframe: str) -> Column:
    """Start of the window that holds ts, on the UTC epoch grid; months start on their first day."""
    if timeframe == "1mo":
        return F.date_trunc("month", ts)
    step = seconds(timeframe)
    at = F.unix_seconds(ts)
    return F.timestamp_seconds(at - F.pmod(at, F.lit(step)))


def window_end(start: Column, timeframe: str) -> Column:
    if timeframe == "1mo":
        return F.add_months(start.cast("date"), 1).cast("timestamp")
    return F.timestamp_seconds(F.unix_seconds(start) + seconds(timeframe))


def later(ts: Column, minutes: int | Column) -> Column:
    """ts moved by minutes; fractions of a second stay."""
    return F.timestamp_micros(F.unix_micros(ts) + (F.lit(minutes) if isinstance(minutes, int) else minutes).cast("long") * 60_000_000)
