"""Sequences that look back and paths that look ahead, within contiguous runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.bars import BPS, clipped, path_parts, price, rebuilt_bar, shapes
from tickloom.operators.segments import with_segments, within_segment
from tickloom.schema import SERIES, later, seconds

PARTS = ["gap", "body", "upper", "lower"]
STEPS = 5
SEQUENCES = {"1min": 60, "3min": 20, "15min": 8, "1h": 4}  # fixed values: bars of each timeframe


def sequences(bars: DataFrame, timeframe: str, length: int) -> DataFrame:
    """For every bar the last `length` bars' return and five shapes as an array, with seq_ok: whether all are there, in one run,
    each with a return. A bar's array ends with itself."""
    w = within_segment()
    base = with_segments(bars, seconds(timeframe)).withColumn("_r", BPS * (F.log(price("close")) - F.log(F.lag(price("close")).over(w))))
    one = F.struct(F.col("_r").alias("log_return_bps"), *[v.alias(k) for k, v in shapes().items()])
    frame = w.rowsBetween(1 - length, 0)
    out = base.withColumn("_one", one).select(*SERIES, F.col("timestamp_close_utc").alias("available_at_utc"), F.collect_list("_one").over(frame).alias("sequence"), (F.count("_r").over(frame) == length).alias("seq_ok"))
    return out.withColumn("sequence", F.when(F.col("seq_ok"), F.col("sequence")))


def attach_sequences(predictions: DataFrame, found: DataFrame, timeframe: str) -> DataFrame:
    """The sequence of the latest bar closed at or before each prediction, at most one bar old: an as-of join on the grid."""
    from tickloom.operators.asof import asof_on_grid

    return asof_on_grid(predictions, found, timeframe, ["sequence", "seq_ok"])


def future_paths(bars: DataFrame, timeframe: str = "3min", steps: int = STEPS) -> DataFrame:
    """For each bar, as anchor, the next `steps` bars' parts in log bps (path_<step>_<part>), the anchor's close, and open, high,
    low and close over the whole path. Only where all of them follow without a gap."""
    w = within_segment()
    base = with_segments(bars, seconds(timeframe))
    for k in range(1, steps + 1):
        base = base.withColumn(f"_b{k}", F.lead(F.struct("bid_open", "bid_high", "bid_low", "bid_close"), k).over(w))
    ahead = base.filter(F.col(f"_b{steps}").isNotNull())
    at = lambda k: [F.col(f"_b{k}.bid_{x}") for x in ("open", "high", "low", "close")]
    parts, previous = [], price("close")
    for k in range(1, steps + 1):
        parts += [v.alias(f"path_{k}_{p}") for p, v in zip(PARTS, path_parts(previous, *at(k)), strict=True)]
        previous = at(k)[3]
    whole = [at(1)[0].alias("agg_open"), F.greatest(*[at(k)[1] for k in range(1, steps + 1)]).alias("agg_high"), F.least(*[at(k)[2] for k in range(1, steps + 1)]).alias("agg_low"), at(steps)[3].alias("agg_close")]
    return ahead.select(*SERIES, F.col("timestamp_close_utc").alias("prediction_time_utc"), later(F.col("timestamp_close_utc"), steps * seconds(timeframe) // 60).alias("path_end_utc"), price("close").alias("anchor_close"), *parts, *whole)


def rebuilt(paths: DataFrame, steps: int = STEPS, clip: float = 5000.0, prefix: str = "path") -> DataFrame:
    """OHLC of each step rebuilt from the parts (step_<k>_open ...), and rebuilt_open, high, low, close of the whole path."""
    out, previous = paths, F.col("anchor_close")
    for k in range(1, steps + 1):
        bar = rebuilt_bar(previous, *[F.col(f"{prefix}_{k}_{p}") for p in PARTS], clip=clip)
        out = out.withColumns({f"step_{k}_{x}": v for x, v in zip(("open", "high", "low", "close"), bar, strict=True)})
        previous = F.col(f"step_{k}_close")
    high, low = F.greatest(*[F.col(f"step_{k}_high") for k in range(1, steps + 1)]), F.least(*[F.col(f"step_{k}_low") for k in range(1, steps + 1)])
    return out.withColumns({"rebuilt_open": F.col("step_1_open"), "rebuilt_high": high, "rebuilt_low": low, "rebuilt_close": previous})


def path_return(steps: int = STEPS, clip: float = 5000.0, prefix: str = "path") -> Column:
    """The path's log return in bps from its parts: the sum of clipped gaps and bodies."""
    return sum([clipped(F.col(f"{prefix}_{k}_{p}"), -clip, clip) for k in range(1, steps + 1) for p in ("gap", "body")], F.lit(0.0))


def quantile_metrics(rows: DataFrame, actual: str, q10: Column, q50: Column, q90: Column, by: list[str]) -> DataFrame:
    """MAE of the median, coverage and mean width of the outer quantiles, and pinball losses, by group."""
    from tickloom.functions.bars import pinball

    y = F.col(actual)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(y - q50)).alias("mae"), F.avg(y.between(q10, q90).cast("double")).alias("coverage"), F.avg(q90 - q10).alias("width"), *[F.avg(pinball(q, y - c)).alias(f"pinball_{n}") for q, c, n in ((0.1, q10, "q10"), (0.5, q50, "q50"), (0.9, q90, "q90"))])


def long_parts(paths: DataFrame, steps: int = STEPS) -> DataFrame:
    """A row for each step and part."""
    return paths.select(*SERIES, "prediction_time_utc", F.inline(F.array(*[F.struct(F.lit(k).alias("step"), F.lit(p).alias("part"), F.col(f"path_{k}_{p}").alias("value")) for k in range(1, steps + 1) for p in PARTS])))
