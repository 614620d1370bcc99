"""Named queries over streams: bars derived from the events table, replayed file by file, and what the stream emitted as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import backtest, features, resample
from tickloom.plans.catalog import POLICY, TRADED, COSTS, _asof_sides, _repeated, bar_columns, clocks, predictions, query
from tickloom.schema import SERIES
from tickloom.scratch import written
from tickloom.sources.events import events, tick_bars
from tickloom.streaming import bars as stream
from tickloom.streaming.replay import online_rows, outcome, streamed
from tickloom.streaming.state import latest_fresh, silences

PARTS = 6


def _feed(rows, time="timestamp_open_utc"):
    return streamed(rows, time, PARTS)


@query
def stream_ohlc_3min(spark, d):
    """Dense three-minute windows that the watermark has passed."""
    done = outcome(spark, stream.tumbling_ohlc(_feed(clocks(spark, d)), "3min"))
    return bar_columns(done.withColumn("timeframe", F.lit("3min")))


@query
def stream_sessions(spark, d):
    return outcome(spark, stream.sessions(_feed(clocks(spark, d)))).drop("source")


@query
def stream_first_deliveries(spark, d):
    """Bars delivered again, counted once; a bar that differs stays."""
    kept = outcome(spark, stream.without_repeats(_feed(written(_repeated(spark, d)))))
    return kept.groupBy("instrument").agg(F.count("*").alias("n"), F.sum("bid_close").alias("sum_close"))


@query
def stream_asof(spark, d):
    """Each prediction once, with the latest 15-minute block at most 40 minutes old."""
    left, right = _asof_sides(spark, d)
    name = "p7_15min_log_return_1_bps"
    both = left.select(*SERIES, F.col("prediction_time_utc").alias("t"), F.lit(None).cast("double").alias(name), F.lit(True).alias("asked")).unionByName(right.select(*SERIES, F.col("available_at_utc").alias("t"), name, F.lit(False).alias("asked")))
    feed = _feed(written(both), "t")
    found = latest_fresh(feed.filter("asked").withColumnRenamed("t", "prediction_time_utc"), feed.filter("NOT asked").withColumnRenamed("t", "available_at_utc"), 40, [name])
    return outcome(spark, found).drop("source").withColumnRenamed("available_at_utc", "asof_utc")


@query
def stream_positions(spark, d):
    """Signals that a stream of them executes."""
    decided = backtest.with_decisions(predictions(spark, d).select(*TRADED), COSTS, POLICY).filter("decision_status = 'signal'")
    done = outcome(spark, stream.positions(_feed(written(decided.select("instrument", "prediction_time_utc", "entry_time_utc", "label_end_time_utc", "horizon_minutes")), "prediction_time_utc")))
    return done.filter("executed").drop("executed")


@query
def stream_silences(spark, d):
    """Hours of ticks that stop for two hours or more, told by timers where nothing comes after."""
    return outcome(spark, silences(_feed(written(tick_bars(events(spark, d)))), 120, "1 hour")).drop("source")


@query
def stream_online_features(spark, d):
    """The features of each series at the end of each file, from the last three hours of bars alone."""
    rows = online_rows(_feed(clocks(spark, d)), lambda bars: features.mvp_features(resample.resample(bars, "3min")).drop("seg"), 180)
    return rows.drop("source", "batch")
