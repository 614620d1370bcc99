"""Named queries over the driver tables, one or more for each operator family."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.bars import CLASSES, sessions
from tickloom.operators import asof, backtest, benchmark, boosting, calendars, contracts, features, labels, metrics, paths, quality, resample, splits, validate, walkforward, wide
from tickloom.operators.segments import days_together, with_segments
from tickloom.schema import SERIES, later, seconds
from tickloom.scratch import written
from tickloom.session import in_utc
from tickloom.sources.events import both_clocks, events, minute_clock, tick_bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Results that compare across engines: times without zone, doubles to four places, flags as integers."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, 4) + F.lit(0.0)
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(in_utc(spark), sf_dir))
    return f


def clocks(spark: SparkSession, d: str) -> DataFrame:
    """The minute bars as a table: a join of the events with themselves, written once for all that reads them, days together."""
    return written(days_together(both_clocks(events(spark, d))))


def bars3(spark: SparkSession, d: str) -> DataFrame:
    return resample.resample(clocks(spark, d), "3min")


def feats3(bars: DataFrame) -> DataFrame:
    """The MVP features of minute bars; their three-minute bars are read twice (runs, and days of runs)."""
    return features.mvp_features(written(resample.resample(bars, "3min")))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """The labelled model table: features of 3-minute bars joined with 15-minute labels, and probabilities by a fixed rule."""
    bars = clocks(spark, d)
    three = written(resample.resample(bars, "3min"))
    lab = labels.build_labels(bars, three.select(*SERIES, F.col("timestamp_close_utc").alias("prediction_time_utc")))
    return scored(features.mvp_features(three).join(lab, [*SERIES, "prediction_time_utc"]))


def scored(rows: DataFrame) -> DataFrame:
    m = F.col("momentum_5_bps")
    top = 0.34 + 0.6 * F.abs(m) / (F.abs(m) + 20.0)
    rest = (1 - top) / 2
    up, down = m > 2, m < -2
    return rows.withColumns({"p_down": F.when(down, top).otherwise(rest), "p_neutral": F.when(up | down, rest).otherwise(top), "p_up": F.when(up, top).otherwise(rest), "expected_return_bps": 0.3 * m})


def bar_columns(df: DataFrame) -> DataFrame:
    return df.select("instrument", "source", "timeframe", "timestamp_open_utc", "timestamp_close_utc", "bid_open", "bid_high", "bid_low", "bid_close")


@query
def candles_1min(spark, d):
    return bar_columns(both_clocks(events(spark, d)))


@query
def candles_ticks_1h(spark, d):
    return bar_columns(tick_bars(events(spark, d)))


def _resampled(timeframe: str):
    def run(spark, d):
        return bar_columns(resample.resample(clocks(spark, d), timeframe))

    run.__name__ = f"resample_{timeframe}"
    query(run)


for _t in ("3min", "5min", "15min", "30min", "1h", "3h"):
    _resampled(_t)


@query
def resample_1d_sparse(spark, d):
    """Days whose missing minutes are all in closures that a calendar names: here the clock's own gap rules."""
    raw = events(spark, d)
    bars = minute_clock(raw)
    i = F.col("event_id")
    shut = raw.filter((i % 997 == 500) | (i % 5000).between(2000, 2180)).select(F.lit("CLOCK_A").alias("instrument"), F.lit("clock").alias("source"), F.timestamp_seconds(F.lit(1_704_067_200) + i * 60).alias("timestamp_open_utc"))
    return bar_columns(resample.resample(bars, "1d", closed_minutes=shut))


@query
def resample_windows_1mo(spark, d):
    """Calendar months with how many bars they hold and how many a full month needs."""
    w = resample.windows(tick_bars(events(spark, d)), "1mo")
    return w.select("instrument", "window_open", "window_close", "bid_open", "bid_high", "bid_low", "bid_close", "n_bars", resample.expected_bars("1h").alias("n_expected"))


@query
def resample_multi(spark, d):
    return resample.resample_many(clocks(spark, d), ["3min", "15min", "1h"]).groupBy("timeframe", "instrument").agg(F.count("*").alias("n"), F.sum("bid_close").alias("sum_close"), F.max("bid_high").alias("max_high"))


@query
def lineage_hash(spark, d):
    return resample.resample(clocks(spark, d), "15min").select("instrument", "timestamp_open_utc", "raw_file_hash")


@query
def validate_counts(spark, d):
    return validate.violation_counts(_damaged(spark, d))


def _damaged(spark, d):
    """The clock with planted defects."""
    m = F.floor(F.unix_seconds("timestamp_open_utc") / 60)
    bars = clocks(spark, d)
    return bars.withColumns({
        "bid_high": F.when(m % 101 == 3, F.col("bid_low") - 1).when(m % 103 == 4, float("nan")).otherwise(F.col("bid_high")),
        "is_complete": F.when(m % 107 == 5, False).when(m % 109 == 6, None).otherwise(F.col("is_complete")),
        "source": F.when(m % 113 == 7, " ").otherwise(F.col("source")),
        "timestamp_close_utc": F.when(m % 127 == 8, F.col("timestamp_open_utc")).otherwise(F.col("timestamp_close_utc")),
    })


@query
def invalid_bars(spark, d):
    return _damaged(spark, d).filter(validate.invalid_ohlc()).select("instrument", "timestamp_open_utc")


def _repeated(spark, d, bars=None):
    """A clock with planted repeats; bars: the minute bars, where a plan has them."""
    bars = written(days_together(minute_clock(events(spark, d)))) if bars is None else bars.filter("instrument = 'CLOCK_A'")
    m = F.floor(F.unix_seconds("timestamp_open_utc") / 60)
    return bars.unionByName(bars.filter(m % 50 == 0)).unionByName(bars.filter(m % 75 == 0).withColumn("bid_close", F.col("bid_close") + 1))


@query
def conflict_keys(spark, d):
    return validate.conflicting_keys(_repeated(spark, d)).select("instrument", "timestamp_open_utc", "n_rows", "n_different")


@query
def dedup_identical(spark, d):
    return validate.drop_identical(_repeated(spark, d)).agg(F.count("*").alias("n"), F.sum("bid_close").alias("sum_close"))


@query
def gap_report(spark, d):
    return validate.gaps(clocks(spark, d), "1min")


@query
def gap_summary(spark, d):
    return validate.gaps(clocks(spark, d), "1min").groupBy("instrument").agg(F.count("*").alias("n_gaps"), F.sum("missing_bars").alias("missing"))


@query
def coverage(spark, d):
    return calendars.coverage(resample.resample_many(clocks(spark, d), ["3min", "15min"]))


@query
def segments(spark, d):
    return with_segments(clocks(spark, d), 60, positions=True).groupBy("instrument", "seg").agg(F.count("*").alias("n"), F.max("seg_pos").alias("last_pos"))


@query
def features_mvp(spark, d):
    return feats3(clocks(spark, d)).select("instrument", "prediction_time_utc", "feature_window_start_utc", *features.FEATURES)


@query
def price_block_15min(spark, d):
    return features.price_block(resample.resample(clocks(spark, d), "15min"), "15min", (2, 4, 8, 16)).drop("source")


@query
def regime_features(spark, d):
    return features.regimes(written(feats3(clocks(spark, d)))).drop("source")


@query
def session_flags(spark, d):
    return bars3(spark, d).select("instrument", F.col("timestamp_close_utc").alias("prediction_time_utc"), *[v.alias(k) for k, v in sessions(F.col("timestamp_close_utc")).items()])


def _asof_sides(spark, d):
    bars = clocks(spark, d)
    left = resample.resample(bars, "3min").select(*SERIES, F.col("timestamp_close_utc").alias("prediction_time_utc"))
    right = features.price_block(resample.resample(bars, "15min"), "15min", (2, 4)).select(*SERIES, "available_at_utc", "p7_15min_log_return_1_bps", "p7_15min_price_zscore_4")
    return left, right


@query
def asof_features(spark, d):
    left, right = _asof_sides(spark, d)
    return asof.asof_on_grid(left, right, "15min", ["p7_15min_log_return_1_bps", "p7_15min_price_zscore_4"]).drop("source")


@query
def asof_tolerance(spark, d):
    left, right = _asof_sides(spark, d)
    return asof.asof_general(left, right, ["p7_15min_log_return_1_bps"], 2400).drop("source")


@query
def features_wide(spark, d):
    """The MVP features with two as-of timeframes and the regime block, by instrument and day: counts and means."""
    bars = clocks(spark, d)
    feats = written(feats3(bars))
    blocks = {t: (features.price_block(resample.resample(bars, t), t, w), features.price_names(t, w), seconds(t)) for t, w in (("5min", (2, 5)), ("15min", (2, 4)))}
    whole = asof.asof_many(feats.drop("seg"), blocks).join(features.regimes(feats), [*SERIES, "prediction_time_utc"])
    named = ["momentum_20_bps", "p7_5min_price_zscore_5", "p7_15min_breakout_position_4", "regime_trend_score"]
    return whole.groupBy("instrument", F.to_date("prediction_time_utc").alias("day")).agg(F.count("*").alias("n_rows"), *[x for n in named for x in (F.count(n).alias(f"n_{n}"), F.avg(n).alias(f"avg_{n}"))])


@query
def feature_availability_by_timeframe(spark, d):
    """For each timeframe of the feature table the predictions that have a fresh bar of it, and that bar's mean age."""
    table = wide.feature_table(both_clocks(events(spark, d)))
    age = lambda t: F.avg(F.unix_seconds("prediction_time_utc") - F.unix_seconds(f"asof_{t}_utc"))
    sums = table.groupBy("instrument").agg(F.count("*").alias("n"), *[x for t in wide.WINDOWS for x in (F.count(f"asof_{t}_utc").alias(f"n_{t}"), age(t).alias(f"age_{t}"))])
    return sums.select("instrument", "n", F.inline(F.array(*[F.struct(F.lit(t).alias("timeframe"), F.col(f"n_{t}").alias("n_fresh"), F.col(f"age_{t}").alias("mean_age_seconds")) for t in wide.WINDOWS])))


@query
def feature_variants(spark, d):
    """The five sets of the ablation: features, and rows that have them all."""
    return benchmark.variant_support(wide.feature_table(both_clocks(events(spark, d))), wide.feature_sets())


@query
def label_h15(spark, d):
    bars = clocks(spark, d)
    return labels.build_labels(bars, _candidates(bars)).drop("source")


def _candidates(bars):
    return resample.resample(bars, "3min").select(*SERIES, F.col("timestamp_close_utc").alias("prediction_time_utc"))


@query
def label_all_horizons(spark, d):
    bars = clocks(spark, d)
    return labels.build_labels(bars, _candidates(bars), labels.HORIZONS).groupBy("instrument", "horizon_minutes", "target_class").agg(F.count("*").alias("n"), F.sum("future_return_bps").alias("sum_return"), F.sum("future_range_bps").alias("sum_range"), F.sum("future_realized_vol_bps").alias("sum_vol"))


@query
def label_exact_join(spark, d):
    bars = clocks(spark, d)
    return labels.labels_by_join(bars, _candidates(bars)).drop("source")


@query
def sample_ids(spark, d):
    bars = clocks(spark, d)
    return labels.with_sample_ids(labels.build_labels(bars, _candidates(bars))).select("sample_id", "sample_hash", "target_class_id")


def _spanned(rows, spark, d):
    """rows with the clock's first minute and number of minutes, one row of the whole events table."""
    i = F.col("event_id")
    span = events(spark, d).agg(F.timestamp_seconds(F.lit(1_704_067_200) + F.min(i) * 60).alias("_first"), (F.max(i) - F.min(i) + 1).alias("_minutes"))
    return rows.join(F.broadcast(span))


def _at(k: int, n: int):
    """The time at k n-ths of the whole series."""
    return F.timestamp_seconds(F.unix_seconds("_first") + F.expr(f"_minutes * {k} div {n}") * 60)


def _split(spark, d):
    """Three fifths to train on, a fifth each to validate and to test."""
    return splits.assign_split(_spanned(predictions(spark, d), spark, d), _at(3, 5), _at(4, 5), _at(5, 5), 16)


@query
def split_assign(spark, d):
    return _split(spark, d).groupBy("instrument", "split").agg(F.count("*").alias("n"), F.min("prediction_time_utc").alias("first_time"), F.max("label_end_time_utc").alias("last_end"))


FOLDS = 3


def _blocks():
    """Sixths of the series: each fold trains on all before its calibration, and tests on the sixth after that."""
    parts = [(f"f{i}-{name}", a, b) for i in range(FOLDS) for name, a, b in (("train", 0, 2 + i), ("calibration", 2 + i, 3 + i), ("test", 3 + i, 4 + i))]
    return [splits.Block(name, _at(a, 2 * FOLDS), _at(b, 2 * FOLDS)) for name, a, b in parts]


@query
def walk_forward_blocks(spark, d):
    return splits.assign_blocks(_spanned(predictions(spark, d), spark, d), _blocks(), 181).groupBy("block").agg(F.count("*").alias("n"), F.max("label_end_time_utc").alias("last_end"))


@query
def holdout_violations(spark, d):
    return splits.guard_violations(predictions(spark, d).select("prediction_time_utc", "entry_time_utc", "label_end_time_utc"), datetime(2024, 1, 6))


STATS = ["momentum_5_bps", "realized_volatility_20_bps", "candle_body_bps"]


def _train(spark, d):
    """The training part, with some values taken out."""
    return _split(spark, d).filter("split = 'train'").withColumn("momentum_5_bps", F.when(F.col("momentum_5_bps") > 30, None).otherwise(F.col("momentum_5_bps")))


@query
def impute_scale_stats(spark, d):
    return splits.impute_scale_stats(_train(spark, d), STATS)


@query
def feature_distribution(spark, d):
    return splits.distribution(_split(spark, d), STATS)


@query
def mean_shift(spark, d):
    return splits.mean_shift(splits.distribution(_split(spark, d), STATS))


@query
def class_weights(spark, d):
    return splits.class_weights(predictions(spark, d))


@query
def baseline_rules(spark, d):
    rows = predictions(spark, d)
    from tickloom.functions.bars import return_class

    last, m = F.col("close_log_return_1_bps"), F.col("momentum_20_bps")
    opposite = F.when(m > 6, "down").when(m < -6, "up").otherwise("neutral")
    said = {"last_candle": return_class(last, 6.0), "momentum": return_class(m, 6.0), "mean_reversion": opposite, "always_neutral": F.lit("neutral")}
    long = rows.select("target_class", F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("said")) for k, v in said.items()])))
    return long.groupBy("rule").agg(F.count("*").alias("n"), F.count_if(F.col("said") == F.col("target_class")).alias("n_right"))


@query
def baseline_most_frequent(spark, d):
    from tickloom.functions.bars import class_id

    counts = predictions(spark, d).groupBy("instrument", "target_class").agg(F.count("*").alias("n"))
    return counts.groupBy("instrument").agg(F.max_by("target_class", F.struct("n", -class_id(F.col("target_class")))).alias("most_frequent"), F.max("n").alias("n"))


@query
def continuous_baselines(spark, d):
    rows = predictions(spark, d)
    median = rows.agg(F.percentile("future_range_bps", 0.5).alias("median_range"))
    scale = (15 / 60) ** 0.5
    return rows.join(F.broadcast(median)).agg(F.avg(F.abs("future_return_bps")).alias("zero_return_mae"), F.avg(F.abs(F.col("future_realized_vol_bps") - F.col("realized_volatility_20_bps") * scale)).alias("vol_mae"), F.avg(F.abs(F.col("future_range_bps") - F.col("median_range"))).alias("range_mae"))


@query
def probability_contract(spark, d):
    rows = predictions(spark, d).withColumn("p_up", F.when(F.minute("prediction_time_utc") == 0, F.col("p_up") + 0.1).otherwise(F.col("p_up")))
    return rows.groupBy("instrument").agg(F.count("*").alias("n"), F.count_if(metrics.bad_probabilities()).alias("n_bad"))


@query
def confusion_matrix(spark, d):
    return metrics.confusion(predictions(spark, d))


@query
def classification_metrics(spark, d):
    return metrics.classification_metrics(predictions(spark, d), ["instrument"])


@query
def metrics_by_hour(spark, d):
    return metrics.metrics_by_hour(predictions(spark, d)).select("utc_hour", "n", "accuracy", "macro_f1", "brier")


@query
def reliability_buckets(spark, d):
    return metrics.reliability(predictions(spark, d))


@query
def calibration_error(spark, d):
    return metrics.expected_calibration_error(predictions(spark, d))


@query
def return_errors(spark, d):
    return metrics.return_errors(predictions(spark, d), F.col("expected_return_bps"), F.col("future_return_bps"))


@query
def fold_summary(spark, d):
    per = metrics.classification_metrics(predictions(spark, d), ["instrument", F.to_date("prediction_time_utc").alias("day")])
    return metrics.fold_summary(per, {"accuracy": True, "brier": False}, ["instrument"])


@query
def seed_ensemble(spark, d):
    rows = labels.with_sample_ids(predictions(spark, d))
    ps = [f"p_{c}" for c in CLASSES]
    members = rows.select("sample_id", *ps, "expected_return_bps").unionByName(rows.select("sample_id", F.lit(0.2).alias("p_down"), F.lit(0.2).alias("p_neutral"), F.lit(0.6).alias("p_up"), (F.col("expected_return_bps") + 1).alias("expected_return_bps")))
    return metrics.ensemble(members, "sample_id", ps, ["expected_return_bps"])


COSTS, STRESS = backtest.Costs(), backtest.Costs(spread_bps=4.5)
POLICY = backtest.Policy(0.5, -2.0)


TRADED = [*SERIES, "prediction_time_utc", "entry_time_utc", "label_end_time_utc", "horizon_minutes", *[f"p_{c}" for c in CLASSES], "expected_return_bps", "entry_bid_open", "exit_bid_open", "future_return_bps"]


def _tested(spark, d, costs=COSTS):
    return backtest.run_backtest(predictions(spark, d).select(*TRADED), costs, POLICY)


@query
def decision_status(spark, d):
    return backtest.decision_counts(backtest.with_decisions(predictions(spark, d), COSTS, POLICY))


@query
def nonoverlap_trades(spark, d):
    return _tested(spark, d).filter("decision_status = 'executed'").select("instrument", "prediction_time_utc", "entry_time_utc", "label_end_time_utc", "predicted_class")


@query
def trade_pnl_base(spark, d):
    return _tested(spark, d).filter("decision_status = 'executed'").select("instrument", "prediction_time_utc", "entry_fill_price", "exit_fill_price", "gross_return_bps", "spread_cost_bps", "slippage_cost_bps", "cost_bps", "net_return_bps", "utc_hour", "utc_session")


@query
def trade_summary_base(spark, d):
    return backtest.trade_summary(_tested(spark, d))


@query
def trade_summary_stress(spark, d):
    return backtest.trade_summary(_tested(spark, d, STRESS))


@query
def trade_log_pnl(spark, d):
    return backtest.log_pnl(_tested(spark, d), 4.0).agg(F.count("*").alias("n"), F.sum("net_log_bps").alias("net_log_bps"))


@query
def trade_grouped(spark, d):
    return backtest.grouped_summaries(_tested(spark, d)).select("dimension", "level", "n_trades", "gross_bps", "net_bps", "hit_rate")


@query
def decision_counts(spark, d):
    return backtest.decision_counts(_tested(spark, d))


@query
def exposure(spark, d):
    return backtest.exposure(_tested(spark, d))


@query
def max_drawdown(spark, d):
    return backtest.max_drawdown(_tested(spark, d))


@query
def policy_select(spark, d):
    rows, costs = predictions(spark, d).select(*TRADED), backtest.Costs(0.0, 0.0)
    policies = (backtest.Policy(0.4, -9.0), backtest.Policy(0.5, -3.0), backtest.Policy(0.6, -3.0))
    for i, p in enumerate(policies):
        rows = backtest.with_decisions(rows, costs, p).withColumnRenamed("decision_status", f"_s{i}")
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("policy"), F.col(f"_s{i}").alias("decision_status")) for i in range(len(policies))]))
    long = rows.select("*", each).withColumn("instrument", F.concat_ws("#", "instrument", "policy"))  # one run of trades a policy
    done = backtest.with_pnl(backtest.without_overlap(long), costs).filter("decision_status = 'executed'")
    results = done.groupBy("policy", F.to_date("prediction_time_utc").alias("fold")).agg(F.count("*").alias("n_trades"), F.sum("net_return_bps").alias("net_bps"))
    return backtest.select_policy(results, 3)


WEEK = [*[(wd, 0, 1320) for wd in range(5)], (6, 1320, 1440)]
SPECIAL = [("holiday", "2024-01-01 06:00:00", "2024-01-01 09:00:00"), ("maintenance", "2024-01-01 08:00:00", "2024-01-01 10:00:00"), ("holiday", "2024-01-03 23:00:00", "2024-01-04 02:00:00")]


def _calendar(spark):
    return calendars.weekly_windows(spark, WEEK), calendars.exceptions(spark, SPECIAL)


@query
def calendar_states(spark, d):
    return calendars.states(clocks(spark, d), *_calendar(spark)).groupBy("instrument", F.to_date("timestamp_open_utc").alias("day"), "market_status").agg(F.count("*").alias("n"))


@query
def calendar_expected(spark, d):
    hours = tick_bars(events(spark, d)).select(*SERIES, "timestamp_open_utc")
    return calendars.interval_expected(hours, *_calendar(spark), "1h").groupBy("instrument", "market_status").agg(F.count("*").alias("n"), F.count_if("expected").alias("n_expected"))


@query
def expected_grid_anti(spark, d):
    return calendars.missing_slots(clocks(spark, d), "1min").select("instrument", "timestamp_open_utc")


KNOWN = [(1, "2024-01-02 09:00:00", "2024-01-02 12:00:00", "planned", None, None), (2, "2024-01-02 10:00:00", "2024-01-05 00:00:00", "outage", "CLOCK_A", None)]


def _classified(spark, d):
    return calendars.classify_gaps(calendars.missing_slots(clocks(spark, d), "1min"), _known(spark), *_calendar(spark))


@query
def known_gap_range_join(spark, d):
    return _classified(spark, d).groupBy("instrument", "classification", "known_reason").agg(F.count("*").alias("n"))


@query
def gap_islands(spark, d):
    return calendars.gap_islands(_classified(spark, d), "1min").drop("source", "day")


def _known(spark):
    return spark.createDataFrame(KNOWN, "place int, start string, end string, reason string, instrument string, source string").selectExpr("place", "CAST(start AS TIMESTAMP) AS start_utc", "CAST(end AS TIMESTAMP) AS end_utc", "reason", "instrument", "source")


AS_OF = "2024-01-05 00:00:30"


@query
def daily_quality(spark, d):
    """Repeated bars, what is there alone saying what is expected, cut off half a minute into a bar."""
    return quality.daily_quality(_repeated(spark, d), quality.Audit("1min", AS_OF)).drop("source")


@query
def daily_quality_classes(spark, d):
    """The same by a calendar and known gaps, over days from before the first bar on."""
    audit = quality.Audit("1min", AS_OF, calendar=_calendar(spark), known=_known(spark), first_day="2023-12-30")
    return quality.daily_quality(clocks(spark, d), audit).drop("source")


@query
def quality_gaps(spark, d):
    """The gaps of 15-minute bars, by a calendar and known gaps, to the end of the series."""
    audit = quality.Audit("15min", "2034-01-01", calendar=_calendar(spark), known=_known(spark))
    return quality.gap_report(resample.resample(clocks(spark, d), "15min"), audit).drop("source", "day")


@query
def sequence_last20(spark, d):
    s = F.col("sequence")
    ready = paths.sequences(bars3(spark, d), "3min", 20).filter("seq_ok")
    return ready.select("instrument", "available_at_utc", s[0]["log_return_bps"].alias("oldest_return"), s[19]["log_return_bps"].alias("newest_return"), F.aggregate(s, F.lit(0.0), lambda a, x: a + x["candle_range_bps"]).alias("sum_range"))


@query
def sequence_availability(spark, d):
    bars = clocks(spark, d)
    out = _candidates(bars)
    for t in ("3min", "15min"):
        found = paths.sequences(resample.resample(bars, t), t, paths.SEQUENCES[t])
        out = asof.asof_on_grid(out, found, t, ["seq_ok"]).withColumnRenamed("seq_ok", f"ok_{t}").drop(f"asof_{t}_utc")
    return out.groupBy("instrument").agg(F.count("*").alias("n"), F.count_if(F.col("ok_3min")).alias("n_3min"), F.count_if(F.col("ok_15min")).alias("n_15min"))


@query
def future_path_5(spark, d):
    return paths.future_paths(bars3(spark, d)).drop("source")


@query
def path_reconstruct(spark, d):
    r = paths.rebuilt(paths.future_paths(bars3(spark, d)))
    worst = lambda a, b: F.max(F.abs(F.col(a) - F.col(b)))
    return r.groupBy("instrument").agg(F.count("*").alias("n"), *[worst(f"rebuilt_{x}", f"agg_{x}").alias(f"worst_{x}") for x in ("open", "high", "low", "close")], F.sum(paths.path_return()).alias("sum_return"))


@query
def path_quantile_eval(spark, d):
    long = paths.long_parts(paths.future_paths(bars3(spark, d)))
    return paths.quantile_metrics(long, "value", F.lit(-10.0), F.lit(0.5), F.lit(12.0), ["step", "part"])


def _universe(spark, d):
    rows = labels.with_sample_ids(predictions(spark, d))
    return rows, rows.filter(F.minute("prediction_time_utc") % 2 == 0).select("sample_id")


@query
def universe_semi(spark, d):
    rows, kept = _universe(spark, d)
    return rows.join(kept, "sample_id", "left_semi").select("sample_id", "target_class_id")


@query
def universe_anti(spark, d):
    rows, kept = _universe(spark, d)
    return rows.join(kept, "sample_id", "left_anti").select("sample_id", "target_class_id")


@query
def ids_symmetric_difference(spark, d):
    rows, kept = _universe(spark, d)
    a, b = rows.filter(F.minute("prediction_time_utc") % 4 == 0).select("sample_id"), kept
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("b"))).groupBy("only_in").agg(F.count("*").alias("n"))


@query
def ordered_digest(spark, d):
    rows = labels.with_sample_ids(predictions(spark, d)).withColumn("day", F.to_date("prediction_time_utc"))
    return metrics.ordered_digest(rows, "sample_id", "sample_id", ["instrument", "day"])


@query
def topk_latest_row(spark, d):
    return predictions(spark, d).orderBy(F.col("prediction_time_utc").desc(), "instrument").limit(3).select("instrument", "prediction_time_utc", "momentum_5_bps", "target_class")


@query
def candidate_ranking(spark, d):
    per = metrics.classification_metrics(predictions(spark, d), ["instrument", F.to_date("prediction_time_utc").alias("day")])
    w = Window.partitionBy("instrument").orderBy(F.round(F.col("macro_f1"), 6).desc(), F.round("log_loss", 6), "day")
    return per.withColumn("place", F.row_number().over(w)).filter("place <= 2").select("instrument", "day", "place", "macro_f1")


@query
def session_windows(spark, d):
    """Runs as session windows: touching bars of one cadence merge into one session."""
    bars = clocks(spark, d)
    return bars.groupBy("instrument", F.session_window("timestamp_open_utc", "60 seconds")).agg(F.count("*").alias("n")).select("instrument", F.col("session_window.start").alias("start_utc"), F.col("session_window.end").alias("end_utc"), "n")




def _model_sides(spark, d):
    """Rows before and from the middle of the series, with features scaled by the first alone."""
    rows = written(predictions(spark, d).drop("p_down", "p_neutral", "p_up", "expected_return_bps"))
    middle = splits.with_brackets(rows.select(F.unix_seconds("prediction_time_utc").alias("t")), ["t"]).agg(splits.median(splits.bracketed("t"))).first()[0]
    early = F.unix_seconds("prediction_time_utc") < int(middle)
    train = rows.filter(early & (F.unix_seconds("label_end_time_utc") < int(middle)))
    known = written(splits.impute_scale_stats(train, features.FEATURES))
    return splits.standardized(train, known, features.FEATURES), splits.standardized(rows.filter(~early), known, features.FEATURES)


@query
def model_logistic(spark, d):
    """A fitted model's metrics on later rows; no twin in SQL."""
    from tickloom.operators import models

    train, test = _model_sides(spark, d)
    return metrics.classification_metrics(models.score_classes(models.fit_logistic(train, features.FEATURES), test), ["instrument"])


@query
def model_ridge(spark, d):
    from tickloom.operators import models

    train, test = _model_sides(spark, d)
    model, sigma = models.fit_ridge(train, features.FEATURES)
    return metrics.classification_metrics(models.score_ridge(model, sigma, test), ["instrument"])


def _nested_folds() -> list[splits.Fold]:
    """Three years of sixths of the series: a fold trains on what lies before the last quarter of a year, which is for calibration, tests
    on the year after it, and has the two quarters before that for inner validations."""
    def fold(i: int) -> splits.Fold:
        year = 4 * (3 + i)  # in 24ths
        at = lambda k: _at(k, 24)
        inner = tuple((splits.Block(f"f{i}-inner{q}-train", at(0), at(year - q)), splits.Block(f"f{i}-inner{q}", at(year - q), at(year - q + 1))) for q in (3, 2))
        return splits.Fold(f"f{i}", splits.Block(f"f{i}-train", at(0), at(year - 1)), splits.Block(f"f{i}-calibration", at(year - 1), at(year)), splits.Block(f"f{i}-test", at(year), at(year + 4)), inner)

    return [fold(i) for i in range(FOLDS)]


def _nested(spark, d) -> walkforward.Nested:
    rows = _spanned(labels.with_sample_ids(predictions(spark, d).drop("p_down", "p_neutral", "p_up", "expected_return_bps")), spark, d)
    policies = (backtest.Policy(0.4, -2.0), backtest.Policy(0.5, 0.0), backtest.Policy(0.6, 2.0))
    return walkforward.nested_selection(rows, _nested_folds(), gap_minutes=16, balanced=(False, True), costs=backtest.Costs(0.0, 0.0), policies=policies, minimum_trades=5)


@query
def nested_selection(spark, d):
    """Models fitted on inner folds, chosen, refitted and judged on outer tests; no twin in SQL."""
    return _nested(spark, d).report


@query
def model_boosted(spark, d):
    """Three-class trees stopped on an inner validation, refitted with that many rounds, judged on the outer test; no twin in SQL."""
    rows = _spanned(labels.with_sample_ids(predictions(spark, d)), spark, d)
    blocks = walkforward.marked_blocks(rows, _nested_folds()[-1:], features.FEATURES, 16)
    (fold,) = blocks.folds
    inner = boosting.fit_boosted(blocks, fold.inner[-1][0].name, depth=2, most=8, rate=0.3, patience=3)
    model = boosting.fit_boosted(blocks, fold.train.name, depth=2, most=max(1, len(inner.rounds)), rate=0.3, patience=None)
    return metrics.classification_metrics(boosting.score_boosted(blocks, fold.train.name, model), ["instrument"])


@query
def promotion_report(spark, d):
    """Thirteen metrics of the nested selection over its folds, and the tests for promotion; no twin in SQL."""
    return walkforward.promotion(benchmark.horizon_summary(_nested(spark, d).report, walkforward.METRICS))


def _minute(name: str):
    return F.floor(F.unix_seconds(name) / 60)


@query
def candidate_contract(spark, d):
    """Candidates with planted defects: off the grid, repeated, unnamed."""
    c = _candidates(clocks(spark, d))
    m, t = _minute("prediction_time_utc"), F.col("prediction_time_utc")
    broken = c.withColumns({"prediction_time_utc": F.when(m % 101 == 3, later(t, 1)).otherwise(t), "source": F.when(m % 113 == 7, " ").otherwise(F.col("source"))})
    return contracts.candidate_violations(broken.unionByName(broken.filter(m % 50 == 0)))


@query
def ask_contract(spark, d):
    m, bid = _minute("timestamp_open_utc"), F.col("bid_open")
    ask = F.when(m % 101 == 3, bid - 1).when(m % 103 == 4, float("nan")).when(m % 107 == 5, 0.0).when(m % 109 == 6, None).otherwise(bid + 0.3)
    return contracts.ask_violations(clocks(spark, d).withColumn("ask_open", ask))


@query
def target_contract(spark, d):
    bars = clocks(spark, d)
    rows = labels.with_sample_ids(labels.build_labels(bars, _candidates(bars)))
    m = _minute("prediction_time_utc")
    broken = rows.withColumns({
        "target_class_id": F.when(m % 101 == 3, 3).otherwise(F.col("target_class_id")), "arithmetic_return_bps": F.when(m % 103 == 4, float("inf")).otherwise(F.col("arithmetic_return_bps")),
        "sample_id": F.when(m % 107 == 5, "").otherwise(F.col("sample_id")),
    })
    return contracts.target_violations(broken.unionByName(broken.filter(m % 50 == 0)))


@query
def audit_records(spark, d):
    return contracts.audit_records(labels.with_sample_ids(predictions(spark, d))).drop("source")


@query
def class_priors(spark, d):
    return benchmark.class_priors(_split(spark, d).filter("split = 'train'"))


@query
def prior_baseline(spark, d):
    """The training part's class shares, held against the test part."""
    rows = _split(spark, d)
    said = benchmark.prior_predictions(rows.filter("split = 'train'"), rows.filter("split = 'test'"))
    return metrics.classification_metrics(said, ["instrument"]).select("instrument", "n", "accuracy", "log_loss", "brier")


@query
def fold_coverage(spark, d):
    """Blocks of the walk-forward folds, with a feature that is first seen in the second half."""
    rows = _spanned(predictions(spark, d), spark, d).withColumn("late_bps", F.when(F.col("prediction_time_utc") >= _at(1, 2), F.col("momentum_20_bps")))
    return benchmark.fold_coverage(rows, _blocks(), ["momentum_5_bps", "late_bps"])


@query
def label_coverage(spark, d):
    bars = clocks(spark, d)
    return benchmark.label_coverage(_candidates(bars), labels.build_labels(bars, _candidates(bars))).drop("source")


def _path_rows(spark, d):
    bars = clocks(spark, d)
    found = labels.with_sample_ids(labels.build_labels(bars, _candidates(bars)))
    return benchmark.path_dataset(found, benchmark.whole_path_parts(paths.future_paths(resample.resample(bars, "3min"))))


@query
def path_dataset(spark, d):
    return _path_rows(spark, d).select("instrument", "prediction_time_utc", "label_end_time_utc", "path_end_utc", "in_time", "future_return_bps", (F.col("agg_gap") + F.col("agg_body")).alias("path_return_bps"))


@query
def path_unmatched(spark, d):
    """Predictions of every third path, held against the executable samples: how many lack a target."""
    bars = clocks(spark, d)
    ids = paths.future_paths(resample.resample(bars, "3min")).withColumn("horizon_minutes", F.lit(15))
    known = labels.with_sample_ids(predictions(spark, d))
    return contracts.unmatched(labels.with_sample_ids(ids), known).groupBy("instrument").agg(F.count("*").alias("n_unmatched"))


@query
def path_quantile_columns(spark, d):
    """A band around what happened, as the named columns of a path forecast."""
    band = lambda c: F.array(F.col(c) - 5.0, F.col(c), F.col(c) + 5.0)
    steps = F.array(*[F.array(*[band(f"path_{k}_{p}") for p in paths.PARTS]) for k in range(1, paths.STEPS + 1)])
    rows = _path_rows(spark, d).select("instrument", "prediction_time_utc", steps.alias("path_quantiles"), F.array(*[band(f"agg_{p}") for p in paths.PARTS]).alias("whole_quantiles"))
    return benchmark.quantile_columns(rows, ["instrument", "prediction_time_utc"])


@query
def path_normalizer(spark, d):
    return benchmark.part_normalizer(paths.future_paths(bars3(spark, d)))


@query
def sequence_normalizer(spark, d):
    ready = paths.sequences(bars3(spark, d), "3min", 5).filter("seq_ok")
    return benchmark.sequence_normalizer(ready, ["log_return_bps", "candle_range_bps"])


@query
def reference_parity(spark, d):
    """A frozen reference that lacks some samples and tells others apart, held against the universe."""
    rows = labels.with_sample_ids(predictions(spark, d))
    m = _minute("prediction_time_utc")
    frozen = rows.filter(m % 7 != 0).withColumns({"target_class_id": F.when(m % 11 == 0, 9).otherwise(F.col("target_class_id")), "arithmetic_return_bps": F.when(m % 13 == 0, F.col("arithmetic_return_bps") + 0.001).otherwise(F.col("arithmetic_return_bps"))})
    return contracts.parity(frozen, rows.filter(m % 2 == 0))


def _families(spark, d):
    """Metrics a fold (a tenth of the series) of the scored model, of its opposite and of equal chances."""
    rows = _spanned(predictions(spark, d), spark, d)
    fold = F.least(F.floor((F.unix_seconds("prediction_time_utc") - F.unix_seconds("_first")) / 60 * 10 / F.col("_minutes")), F.lit(9))
    p = lambda name, *c: F.struct(F.lit(name).alias("family"), *[x.alias(f"p_{k}") for x, k in zip(c, CLASSES, strict=True)])
    third, down, neutral, up = F.lit(1 / 3), F.col("p_down"), F.col("p_neutral"), F.col("p_up")
    each = F.inline(F.array(p("scored", down, neutral, up), p("opposite", up, neutral, down), p("equal", third, third, third)))
    long = rows.select("target_class", fold.alias("fold"), each)
    return metrics.classification_metrics(long, ["family", "fold"])


SUMMARIZED = {"accuracy": True, "macro_f1": True, "brier": False, "log_loss": False}


@query
def horizon_summary(spark, d):
    return benchmark.horizon_summary(_families(spark, d), SUMMARIZED)


@query
def research_champion(spark, d):
    return benchmark.admitted(benchmark.horizon_summary(_families(spark, d), SUMMARIZED), "opposite")


@query
def selected_candidate(spark, d):
    """Each day's metrics stand for a candidate's, with C and weights by the day."""
    per = metrics.classification_metrics(predictions(spark, d), ["instrument", F.to_date("prediction_time_utc").alias("day")])
    k = F.datediff("day", F.lit("2024-01-01").cast("date"))
    scores = per.select("instrument", "day", F.pow(F.lit(10.0), F.pmod(k, F.lit(5)) - 2).alias("c"), (k % 2 == 1).alias("weighted"), F.round("macro_f1", 2).alias("macro_f1"), F.round("log_loss", 2).alias("log_loss"))
    return benchmark.selected_candidate(scores.groupBy("c", "weighted").agg(F.max("macro_f1").alias("macro_f1"), F.min("log_loss").alias("log_loss")))


@query
def head_and_tail(spark, d):
    rows = predictions(spark, d).select("instrument", "prediction_time_utc", "target_class")
    return benchmark.head_and_tail(rows, 16, ["instrument"], "prediction_time_utc")


@query
def feature_availability(spark, d):
    return benchmark.availability(features.regimes(written(feats3(clocks(spark, d)))), ["regime_trend_score", "regime_shock_score"])


@query
def quality_totals(spark, d):
    """Daily quality summed for each intraday timeframe."""
    bars, out = clocks(spark, d), None
    for t in ("1min", "3min", "5min", "15min", "30min", "1h", "3h"):
        daily = quality.daily_quality(_repeated(spark, d, bars) if t == "1min" else resample.resample(bars, t), quality.Audit(t, AS_OF))
        names = ["n_rows", "n_expected", "n_missing", "n_stale", "n_incomplete", "n_duplicate", "n_invalid", "n_unknown_market_status"]
        one = daily.agg(F.lit(t).alias("timeframe"), F.count("*").alias("n_days"), *[F.sum(n).alias(n) for n in names])
        out = one if out is None else out.unionByName(one)
    return out


from tickloom.plans import streams  # noqa: E402, F401  registers its queries
