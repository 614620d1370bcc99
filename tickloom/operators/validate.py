"""Bar contracts: each guard is a frame of violations or counts, and raising is the caller's choice."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.schema import KEY, MINUTES, PRICES, REQUIRED, SERIES, TIMEFRAMES, floor_to, seconds, window_end


class BarContractError(ValueError):
    """Bars that break the contract."""


def require_columns(bars: DataFrame, names: list[str] = REQUIRED) -> None:
    if missing := [c for c in names if c not in bars.columns]:
        raise BarContractError(f"missing columns: {', '.join(missing)}")
    kinds = dict(zip(bars.schema.names, bars.schema.fields, strict=True))
    naive = [c for c in names if isinstance(kinds[c].dataType, T.TimestampNTZType)]
    if naive:
        raise BarContractError(f"times without a zone: {', '.join(naive)}; state their offset first")
    if wrong := [c for c in PRICES if c in names and not isinstance(kinds[c].dataType, (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.DecimalType))]:
        raise BarContractError(f"prices that are not numbers: {', '.join(wrong)}")


def unusual(c: str) -> Column:
    """Null, NaN, infinite, or not positive."""
    x = F.col(c)
    return x.isNull() | F.isnan(x) | (x == float("inf")) | (x <= 0)


def invalid_ohlc() -> Column:
    o, h, low, c = (F.col(p) for p in PRICES)
    return reduce(or_, [unusual(p) for p in PRICES]) | F.coalesce((h < F.greatest(o, c)) | (low > F.least(o, c)) | (h < low), F.lit(True))


def incomplete(as_of: Column | None = None) -> Column:
    flag = F.coalesce(~F.col("is_complete"), F.lit(True))
    return flag if as_of is None else flag | (F.col("timestamp_close_utc") > as_of)


def off_grid() -> Column:
    """Opening times off the timeframe's UTC grid, or closing times that aren't its end."""
    bad = lambda t: (F.col("timestamp_open_utc") != floor_to(F.col("timestamp_open_utc"), t)) | (F.col("timestamp_close_utc") != window_end(F.col("timestamp_open_utc"), t))
    out = F.lit(True)
    for t in TIMEFRAMES:
        out = F.when(F.col("timeframe") == t, F.coalesce(bad(t), F.lit(True))).otherwise(out)
    return out


def blank_text() -> Column:
    return reduce(or_, [F.coalesce(F.trim(F.col(c)) == "", F.lit(True)) for c in ("instrument", "source", "timeframe", "raw_file_hash", "dataset_version")])


CHECKS = {"blank_text": blank_text, "not_complete": incomplete, "invalid_ohlc": invalid_ohlc, "off_grid": off_grid}


def violation_counts(bars: DataFrame) -> DataFrame:
    """One row, one pass: how many bars break each rule of a row, and how many rows and timeframes there are."""
    return bars.agg(F.count("*").alias("n_rows"), F.countDistinct("timeframe").alias("n_timeframes"), *[F.count_if(f()).alias(k) for k, f in CHECKS.items()])


def conflicting_keys(bars: DataFrame) -> DataFrame:
    """Keys that occur more than once, with how often and how many different bars they hold."""
    rest = [c for c in bars.columns if c not in KEY]
    return bars.groupBy(*KEY).agg(F.count("*").alias("n_rows"), F.countDistinct(F.struct(*rest)).alias("n_different")).filter("n_rows > 1")


def drop_identical(bars: DataFrame) -> DataFrame:
    """Exact repeats are one bar; keys with different bars stay, for conflicting_keys to name."""
    return bars.dropDuplicates(bars.columns)


def gaps(bars: DataFrame, timeframe: str) -> DataFrame:
    """Holes in each series: the first and the end of the missing bars, and their number; months count by the calendar. A bar's predecessor is
    looked for within its day; the first of a day meets the last close of the days before, a row a day, so no task holds a series."""
    day = F.to_date("timestamp_open_utc").alias("_day")
    narrow = bars.select(*SERIES, day, "timestamp_open_utc", "timestamp_close_utc")
    days = narrow.groupBy(*SERIES, "_day").agg(F.max_by("timestamp_close_utc", "timestamp_open_utc").alias("_end"))
    before = Window.partitionBy(*SERIES).orderBy("_day")
    carried = days.select(*SERIES, "_day", F.lag("_end").over(before).alias("_carried"))
    within = Window.partitionBy(*SERIES, "_day").orderBy("timestamp_open_utc")
    last = narrow.withColumn("_previous", F.lag("timestamp_close_utc").over(within)).join(carried, [*SERIES, "_day"])
    steps = last.select(*SERIES, F.coalesce("_previous", "_carried").alias("gap_start_utc"), F.col("timestamp_open_utc").alias("gap_end_utc")).filter("gap_start_utc < gap_end_utc")
    if timeframe == "1mo":
        missing = F.round(F.months_between("gap_end_utc", "gap_start_utc")).cast("long")
    else:
        missing = ((F.unix_seconds("gap_end_utc") - F.unix_seconds("gap_start_utc")) / seconds(timeframe)).cast("long")
    return steps.withColumn("missing_bars", missing)


def validate_bars(bars: DataFrame, timeframe: str | None = None, duplicates: str = "raise") -> DataFrame:
    """The bars if they keep the contract, else BarContractError with the counts. duplicates: raise, or drop_identical."""
    require_columns(bars)
    if timeframe is not None and timeframe not in TIMEFRAMES:
        raise BarContractError(f"unknown timeframe {timeframe!r}; known are {', '.join([*MINUTES, '1mo'])}")
    kept = drop_identical(bars) if duplicates == "drop_identical" else bars
    counts = violation_counts(kept).first().asDict()
    found = {k: v for k, v in counts.items() if k in CHECKS and v}
    if counts["n_timeframes"] > 1:
        found["n_timeframes"] = counts["n_timeframes"]
    if timeframe and (other := kept.filter(F.col("timeframe") != timeframe).limit(1).count()):
        found["other_timeframe"] = other
    if repeated := conflicting_keys(kept).limit(1).count():
        found["repeated_keys"] = repeated
    if found:
        raise BarContractError(f"bars break the contract: {found}")
    return kept


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: empty where a one-to-one join is safe."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
