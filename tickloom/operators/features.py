"""Causal features: every frame stays within a contiguous run and is null until it is full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.bars import BPS, clock, price, sessions, shapes
from tickloom.operators.segments import OPEN, with_segments, within_segment
from tickloom.schema import SERIES, seconds


def full(value: Column, counted: Column, size: int) -> Column:
    """value where its frame holds `size` values, else null."""
    return F.when(counted == size, value)


def log_return(w) -> Column:
    return BPS * (F.log(price("close")) - F.log(F.lag(price("close")).over(w)))


def momentum(size: int, w) -> Column:
    return BPS * (F.log(price("close")) - F.log(F.lag(price("close"), size).over(w)))


def realized_vol(ret: str, size: int, w) -> Column:
    frame = w.rowsBetween(1 - size, 0)
    square = F.col(ret) * F.col(ret)
    return full(F.sqrt(F.sum(square).over(frame)), F.count(ret).over(frame), size)


def previous(size: int, w):
    """The frame of the `size` bars before the current one."""
    return w.rowsBetween(-size, -1)


def sma_distance(size: int, w) -> Column:
    f = previous(size, w)
    return full(BPS * (F.log(price("close")) - F.log(F.avg(price("close")).over(f))), F.count(price("close")).over(f), size)


def price_zscore(size: int, w) -> Column:
    f = previous(size, w)
    spread = F.stddev_pop(price("close")).over(f)
    return full((price("close") - F.avg(price("close")).over(f)) / F.when(spread > 1e-9, spread), F.count(price("close")).over(f), size)


def breakout(size: int, w) -> Column:
    f = previous(size, w)
    low, high = F.min(price("low")).over(f), F.max(price("high")).over(f)
    return full((price("close") - low) / F.when(high > low, high - low), F.count(price("close")).over(f), size)


def mvp_features(bars: DataFrame, timeframe: str = "3min", lags: tuple[int, ...] = (1, 2, 3), momenta: tuple[int, ...] = (5, 20), vol: int = 20, averages: tuple[int, ...] = (5, 20)) -> DataFrame:
    """One row a bar whose features are all there: series, prediction_time_utc (the bar's close), the start of the window
    that the features look at, and 18 features by default. One exchange and one sort serve all frames."""
    w = within_segment()
    base = with_segments(bars, seconds(timeframe)).withColumn("close_log_return_1_bps", log_return(w))
    values = {f"close_log_return_lag_{k}_bps": F.lag("close_log_return_1_bps", k).over(w) for k in lags} | shapes()
    values |= {f"momentum_{k}_bps": momentum(k, w) for k in momenta} | {f"realized_volatility_{vol}_bps": realized_vol("close_log_return_1_bps", vol, w)}
    values |= {f"distance_to_sma_{k}_bps": sma_distance(k, w) for k in averages} | clock(F.col("timestamp_close_utc"))
    need = max([k + 1 for k in lags] + list(momenta) + [vol] + list(averages))
    names = ["close_log_return_1_bps", *values]
    out = base.withColumns(values | {"feature_window_start_utc": F.lag(OPEN, need).over(w)})
    ready = F.col("feature_window_start_utc").isNotNull()
    for n in names:
        ready = ready & F.col(n).isNotNull() & (F.abs(n) < float("inf"))
    return out.filter(ready).select(*SERIES, F.col("timestamp_close_utc").alias("prediction_time_utc"), "feature_window_start_utc", "seg", *names)


FEATURES = ["close_log_return_1_bps", *[f"close_log_return_lag_{k}_bps" for k in (1, 2, 3)], "candle_body_bps", "candle_range_bps", "upper_wick_bps", "lower_wick_bps", "close_position", "momentum_5_bps", "momentum_20_bps", "realized_volatility_20_bps", "distance_to_sma_5_bps", "distance_to_sma_20_bps", "hour_sin", "hour_cos", "weekday_sin", "weekday_cos"]


def price_names(timeframe: str, windows: tuple[int, ...], lags: tuple[int, ...] = (1, 2, 3)) -> list[str]:
    """The columns of price_block, in order."""
    longest = max(windows)
    names = ["log_return_1_bps", *[f"log_return_lag_{k}_bps" for k in lags], *shapes(), *[f"{n}_{k}_bps" for k in windows for n in ("momentum", "realized_volatility")]]
    return [f"p7_{timeframe}_{n}" for n in (*names, f"distance_to_sma_{longest}_bps", f"price_zscore_{longest}", f"breakout_position_{longest}")]


def price_block(bars: DataFrame, timeframe: str, windows: tuple[int, ...], lags: tuple[int, ...] = (1, 2, 3), start: str | None = None, asked: tuple[int, int] | None = None) -> DataFrame:
    """Features p7_<timeframe>_* of one timeframe: returns, shapes, momentum and volatility for each window, and distance to
    the mean, z-score and breakout for the longest. Rows with any null are left out before any as-of join, so that an
    older bar can match instead. start: a column for the open of the first bar that the row looks at.
    asked: (step, tolerance) in seconds of an as-of join whose times all stand on a grid of that step; rows that no such time can match, for it is too late
    or the run's next row is there by then, are left out."""
    w, longest = within_segment(), max(windows)
    base = with_segments(bars, seconds(timeframe)).withColumn("_r", log_return(w))
    values = [F.col("_r"), *[F.lag("_r", k).over(w) for k in lags], *shapes().values()]
    for k in windows:
        values += [momentum(k, w), realized_vol("_r", k, w)]
    values += [sma_distance(longest, w), price_zscore(longest, w), breakout(longest, w)]
    names = price_names(timeframe, windows, lags)
    out = base.withColumns(dict(zip(names, values, strict=True)) | {"_start": F.lag(OPEN, max(max(lags) + 1, longest)).over(w)})
    extra = [F.col("_start").alias(start)] if start else []
    if asked:
        step, tolerance = asked
        whole, at = F.col("_start").isNotNull(), F.unix_micros("timestamp_close_utc")
        for n in names:
            whole = whole & F.col(n).isNotNull() & ~F.isnan(n)
        wait = F.pmod(-at, F.lit(step * 1_000_000))
        replaced = F.coalesce(F.lead("_whole").over(w), F.lit(False)) & (F.lit(seconds(timeframe) * 1_000_000) <= wait)
        out = out.withColumn("_whole", whole).withColumn("_taken", (wait <= tolerance * 1_000_000) & ~replaced).filter("_taken")
    return out.na.drop(subset=[*names, "_start"]).select(*SERIES, F.col("timestamp_close_utc").alias("available_at_utc"), *extra, *names)


def at_share(values: Column, q: float, size: int) -> Column:
    """The value at share q of a sorted array of `size` numbers, between two neighbours in proportion."""
    low = int(q * (size - 1))
    return values[low] + (q * (size - 1) - low) * (values[min(low + 1, size - 1)] - values[low])


def regimes(features: DataFrame, lookback: int = 80, shock_rows: int = 20, cadence_seconds: int = 180) -> DataFrame:
    """Volatility terciles over the `lookback` rows before, trend score and buckets, and shocks against the median absolute
    return of the rows before. Null until a frame is full. Runs are those of feature rows, by prediction time.

    A run has no gap, so the rows that a day's frames reach back to are those of a fixed time before midnight: runs are cut into days, and
    such rows also enter the next day. A frame's values are sorted once for all its shares.
    """
    vol, ret, t = F.col("realized_volatility_20_bps"), F.col("close_log_return_1_bps"), F.col("prediction_time_utc")
    day = lambda c: F.floor(F.unix_seconds(c) / 86_400)
    until = F.floor((F.unix_seconds(t) + max(lookback, shock_rows) * cadence_seconds) / 86_400)
    narrow = with_segments(features.select(*SERIES, "prediction_time_utc", "momentum_20_bps", vol, ret), cadence_seconds, "prediction_time_utc")
    cut = narrow.withColumn("_day", F.explode(F.sequence(day(t), until)))
    w = Window.partitionBy(*SERIES, "seg", "_day").orderBy("prediction_time_utc")
    f, g = previous(lookback, w), previous(shock_rows, w)
    base = cut.withColumns({"_vols": F.collect_list(vol).over(f), "_rets": F.collect_list(F.abs(ret)).over(g)}).filter(F.col("_day") == day(t))
    base = base.withColumns({"_vols": F.when(F.size("_vols") == lookback, F.array_sort("_vols")), "_rets": F.when(F.size("_rets") == shock_rows, F.array_sort("_rets"))})
    base = base.withColumns({"_low": at_share(F.col("_vols"), 1 / 3, lookback), "_high": at_share(F.col("_vols"), 2 / 3, lookback), "_scale": at_share(F.col("_rets"), 0.5, shock_rows)})
    trend, shock = F.col("momentum_20_bps") / F.when(vol != 0, vol), F.abs(ret) / F.when(F.col("_scale") != 0, F.col("_scale"))
    ready = F.col("_low").isNotNull() & F.col("_high").isNotNull()
    flag = lambda cond, when: F.when(when, cond.cast("double"))
    return base.select(
        *SERIES, "prediction_time_utc",
        flag(vol < F.col("_low"), ready).alias("regime_volatility_low"), flag(vol.between(F.col("_low"), F.col("_high")), ready).alias("regime_volatility_mid"), flag(vol > F.col("_high"), ready).alias("regime_volatility_high"),
        trend.alias("regime_trend_score"), flag(trend < -1, trend.isNotNull()).alias("regime_trend_down"), flag(F.abs(trend) <= 1, trend.isNotNull()).alias("regime_trend_range"), flag(trend > 1, trend.isNotNull()).alias("regime_trend_up"),
        shock.alias("regime_shock_score"), flag(shock >= 3, shock.isNotNull()).alias("regime_shock"),
    )


def session_features(features: DataFrame) -> DataFrame:
    return features.select(*SERIES, "prediction_time_utc", *[v.alias(k) for k, v in sessions(F.col("prediction_time_utc")).items()])
