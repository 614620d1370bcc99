"""The feature table over all timeframes: one row a prediction, what each timeframe's latest fresh bar says, sessions, regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.bars import sessions
from tickloom.operators import asof, benchmark, features, resample
from tickloom.operators.segments import days_together
from tickloom.schema import PRICES, REQUIRED, SERIES, seconds
from tickloom.scratch import written

# The windows of each timeframe, in its bars.
WINDOWS = {"1min": (2, 5, 10, 20), "3min": (2, 5, 10, 20), "5min": (2, 5, 10, 20), "15min": (2, 4, 8, 16), "30min": (2, 4, 8, 12), "1h": (2, 4, 8), "3h": (2, 3, 5)}
ANCHOR = "3min"
REGIMES = [f"regime_{n}" for n in ("volatility_low", "volatility_mid", "volatility_high", "trend_score", "trend_down", "trend_range", "trend_up", "shock_score", "shock")]


def feature_sets(windows: dict[str, tuple[int, ...]] = WINDOWS) -> dict[str, list[str]]:
    """The five sets of the ablation over these timeframes."""
    price = {t: features.price_names(t, w) for t, w in windows.items()}
    return benchmark.variants(features.FEATURES, price.get(ANCHOR, []), list(sessions(F.lit(None).cast("timestamp"))), REGIMES, [n for t, names in price.items() if t != ANCHOR for n in names])


def feature_table(minutes: DataFrame, windows: dict[str, tuple[int, ...]] = WINDOWS, staleness: float = 1.0) -> DataFrame:
    """A row for each anchor bar with its MVP features: series, prediction_time_utc, feature_window_start_utc (the earliest bar that any of its values
    looks at), feature_available_at_utc, asof_<timeframe>_utc, and all features of feature_sets(). A timeframe's values are those of its latest bar closed by
    then and at most `staleness` bars old, else null; rows are never dropped for what a timeframe lacks.

    Minute bars and anchors are written once and read for every timeframe; all timeframes, and the regimes as one more table whose rows are as old as
    the anchors, meet in one exchange, where only bars enter that an anchor can take.
    """
    bars = written(days_together(minutes.select(*REQUIRED)))
    read = [*SERIES, "timestamp_open_utc", "timestamp_close_utc", *PRICES]
    made = {t: bars if t == "1min" else written(resample.resample(bars, t).select(*read)) for t in {*windows, ANCHOR}}  # each is read twice: runs, and days of runs
    of = made.__getitem__
    anchors = written(features.mvp_features(of(ANCHOR)).drop("seg"))
    fresh = {t: int(seconds(t) * staleness) for t in windows}
    blocks = {t: (features.price_block(of(t), t, w, start=f"_start_{t}", asked=(seconds(ANCHOR), fresh[t])), [f"_start_{t}", *features.price_names(t, w)], fresh[t]) for t, w in windows.items()}
    blocks["regime"] = (features.regimes(anchors.withColumn("seg", F.lit(0))).withColumnRenamed("prediction_time_utc", "available_at_utc"), REGIMES, 0)
    joined = asof.asof_many(anchors, blocks)
    joined = joined.withColumns(sessions(F.col("prediction_time_utc")))
    earliest = F.least("feature_window_start_utc", *[F.col(f"_start_{t}") for t in windows])
    ordered = list(dict.fromkeys(n for names in feature_sets(windows).values() for n in names))
    return joined.withColumn("feature_window_start_utc", earliest).select(*SERIES, "prediction_time_utc", "feature_window_start_utc", F.col("prediction_time_utc").alias("feature_available_at_utc"), *[f"asof_{t}_utc" for t in windows], *ordered)
