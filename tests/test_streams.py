"""Timers, stateful as-of and the online row against the batch."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_core import T0, make_bars, run_of
from tickloom.operators import asof, features, resample
from tickloom.session import in_utc
from tickloom.streaming import bars as stream
from tickloom.streaming.replay import online_rows, outcome, replay_files, streamed
from tickloom.streaming.state import latest_fresh, rocks, silences


def minutes(*spans, instrument="I"):
    return [(instrument, T0 + timedelta(minutes=m)) for a, b in spans for m in range(a, b)]


def some_bars(spark, rows):
    return in_utc(spark).createDataFrame([(i, "s", t, t + timedelta(minutes=1)) for i, t in rows], "instrument string, source string, timestamp_open_utc timestamp, timestamp_close_utc timestamp")


def told(rows):
    return sorted((r.instrument, int((r.silent_from_utc - T0).total_seconds() // 60)) for r in rows.collect())


def test_a_silent_series_is_told_by_a_timer_and_once(spark):
    rows = minutes((0, 30), (60, 90)) + minutes((0, 10), (50, 52), instrument="J") + minutes((0, 5), instrument="K")
    found = outcome(spark, silences(streamed(some_bars(spark, rows), "timestamp_open_utc", 4), 20, "5 minutes"))
    assert told(found) == [("I", 30), ("J", 10), ("J", 52), ("K", 5)]  # J's and K's last ones have no bar after them
    assert found.filter("stale_from_utc <> silent_from_utc + INTERVAL 20 MINUTES").count() == 0
    assert told(outcome(spark, silences(streamed(some_bars(spark, rows), "timestamp_open_utc", 1), 20, "5 minutes"))) == told(found)


def test_timers_outlive_a_restart(spark, tmp_path):
    first, rest = some_bars(spark, minutes((0, 30)) + minutes((0, 10), instrument="J")), some_bars(spark, minutes((30, 80)))
    first.coalesce(1).write.parquet(f"{tmp_path}/in")
    run = lambda: stream.run_available(silences(spark.readStream.schema(first.schema).parquet(f"{tmp_path}/in"), 25, "0 minutes"), f"{tmp_path}/out", f"{tmp_path}/check")
    with rocks(spark):
        run()
        before = spark.read.parquet(f"{tmp_path}/out")
        assert not before.count()
        rest.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
        assert told(spark.read.parquet(f"{tmp_path}/out")) == [("J", 10)]
        run()
        assert spark.read.parquet(f"{tmp_path}/out").count() == 1


@pytest.mark.parametrize("parts", [1, 5])
def test_latest_fresh_is_the_batch_join(spark, parts):
    rng = random.Random(parts)
    at = lambda m: T0 + timedelta(seconds=20 * m)
    asked = [(i, "s", at(m), True, None) for i in "IJ" for m in sorted(rng.sample(range(600), 60))]
    known = [(i, "s", at(m), False, float(m)) for i in "IJ" for m in sorted(rng.sample(range(600), 25))]
    frame = in_utc(spark).createDataFrame(asked + known, "instrument string, source string, t timestamp, asked boolean, x double")
    left, right = frame.filter("asked").select("instrument", "source", F.col("t").alias("prediction_time_utc")), frame.filter("NOT asked").select("instrument", "source", F.col("t").alias("available_at_utc"), "x")
    feed = streamed(frame, "t", parts)
    found = outcome(spark, latest_fresh(feed.filter("asked").withColumnRenamed("t", "prediction_time_utc"), feed.filter("NOT asked").withColumnRenamed("t", "available_at_utc"), 7, ["x"], "1 minute"))
    mark = frame.agg(F.max("t")).first()[0] - timedelta(minutes=1)
    want = asof.asof_general(left.filter(F.col("prediction_time_utc") < F.lit(mark)), right, ["x"], 420).withColumnRenamed("asof_utc", "available_at_utc")
    assert found.exceptAll(want.select(found.columns)).count() == 0 and found.count() == want.count() > 80
    assert found.filter("x IS NULL").count() > 5


def wide(bars):
    """Features of three-minute bars with the latest fresh 15-minute block."""
    feats = features.mvp_features(resample.resample(bars, "3min")).drop("seg")
    block = features.price_block(resample.resample(bars, "15min"), "15min", (2, 4))
    return asof.asof_on_grid(feats, block, "15min", [c for c in block.columns if c.startswith("p7_")])


@pytest.mark.parametrize("parts", [5])
def test_every_online_row_of_a_replay_is_the_batch_row(spark, parts):
    opens = [t for t in run_of(420) if not 200 <= (t - T0).total_seconds() / 60 < 215]
    bars = make_bars(spark, opens).withColumn("bid_close", F.col("bid_open") + F.pmod(F.xxhash64("timestamp_open_utc"), F.lit(9)) / 10.0).unionByName(make_bars(spark, opens, instrument="J"))
    online, batch = online_rows(streamed(bars, "timestamp_open_utc", parts), wide, 240), wide(bars)
    assert online.groupBy("instrument").count().filter(f"count < {parts - 2}").count() == 0 and online.select("instrument").distinct().count() == 2
    assert online.drop("batch").select(batch.columns).exceptAll(batch).count() == 0
    late = online.groupBy("batch").agg(F.max("prediction_time_utc").alias("t"))
    assert late.count() == online.select("batch").distinct().count()


def test_no_bars_no_rows(spark):
    none = some_bars(spark, minutes((0, 3))).limit(0)
    assert outcome(spark, silences(streamed(none, "timestamp_open_utc", 3), 20)).count() == 0


def test_spans_of_a_replay_are_several_files_but_one_batch(spark):
    """No task writes or reads a whole span, and batches still end where spans do, one with few times or no rows too."""
    rows = some_bars(spark, minutes((0, 400)) + minutes((0, 400), instrument="J") + minutes((401, 403), (1199, 1200)))
    path, files = replay_files(rows, "timestamp_open_utc", 4, file_rows=50)
    written = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).count().collect()
    assert files == 5 and len(written) > 8 and max(r["count"] for r in written) < 300 and spark.read.parquet(path).exceptAll(rows).count() == 0 and spark.read.parquet(path).count() == rows.count()
    seen = {}
    stream_of = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
    stream_of.writeStream.trigger(availableNow=True).foreachBatch(lambda b, k: seen.update({k: (b.count(), b.agg(F.max("timestamp_open_utc")).first()[0])})).start().awaitTermination()
    assert [seen[k] for k in sorted(seen)] == [(600, T0 + timedelta(minutes=299)), (202, T0 + timedelta(minutes=402)), (0, None), (1, T0 + timedelta(minutes=1199))]
    sessions = lambda n: {tuple(r) for r in outcome(spark, stream.sessions(streamed(rows, "timestamp_open_utc", 4, file_rows=n))).collect()}
    assert sessions(50) == sessions(10_000) and len(sessions(50)) == 3
