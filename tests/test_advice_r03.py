"""Findings of round 3: what a plan reads and what enters its exchanges, with the results as before."""

import random

from pyspark.sql import functions as F

from tests.llm import brute
from tickloom.functions.bars import sessions
from tickloom.llm import linededup
from tickloom.operators import asof, features, quality, resample, wide
from tickloom.schema import SERIES, seconds
from tickloom.sources.events import both_clocks, events


def test_two_clocks_join_the_events_once(spark, sf_dir):
    plan = both_clocks(events(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_an_audit_reads_its_bars_once(spark, sf_dir, tmp_path):
    both_clocks(events(spark, sf_dir)).write.parquet(f"{tmp_path}/bars")
    found = quality.daily_quality(spark.read.parquet(f"{tmp_path}/bars"), quality.Audit("1min", "2024-01-03"))
    assert found.count() and not [f for f in found.inputFiles() if str(tmp_path) in f]


def test_only_bars_that_an_anchor_can_take_enter_the_feature_table(spark, sf_dir):
    windows = {"1min": (2, 5), "3min": (2, 5), "5min": (2, 5), "15min": (2, 4)}
    minute = F.floor(F.unix_seconds("timestamp_open_utc") / 60)
    bars = both_clocks(events(spark, sf_dir)).filter(minute % 211 != 7)
    bars = bars.withColumns({c: F.when(minute % 17 < 7, 2000.0).otherwise(F.col(c)) for c in ("bid_open", "bid_high", "bid_low", "bid_close")}).localCheckpoint()  # flat bars have no score
    anchors = features.mvp_features(resample.resample(bars, "3min")).drop("seg").localCheckpoint()
    for staleness in (1.0, 2.5):
        made = {t: bars if t == "1min" else resample.resample(bars, t) for t in windows}
        fresh = {t: int(seconds(t) * staleness) for t in windows}
        blocks = {t: (features.price_block(made[t], t, w, start=f"_start_{t}"), [f"_start_{t}", *features.price_names(t, w)], fresh[t]) for t, w in windows.items()}
        whole = asof.asof_many(anchors, blocks).join(features.regimes(anchors.withColumn("seg", F.lit(0))), [*SERIES, "prediction_time_utc"]).withColumns(sessions(F.col("prediction_time_utc")))
        got = wide.feature_table(bars, windows, staleness)
        names = [c for c in got.columns if c not in ("feature_window_start_utc", "feature_available_at_utc")]
        rows = got.select(*names).collect()
        assert len(rows) > 100 and any(r["regime_shock_score"] is not None for r in rows) and len({r["asof_1min_utc"] == r["prediction_time_utc"] for r in rows}) == 2
        assert sorted(map(str, rows)) == sorted(map(str, whole.select(*names).collect()))
    block = lambda **k: features.price_block(bars, "1min", (2, 5), **k).count()
    assert block(asked=(180, 60)) < 0.5 * block()


def test_alike_lines_are_told_without_comparing_strings(spark, monkeypatch):
    """Words changed, put in, left out: told by words; the answer is that of edit similarity for every pair, near its limit too."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 9)))
    rows, alike = [], {}
    for i in range(120):
        a = [word() for _ in range(rng.randint(1, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 1 + len(a) // 2)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
        x, y = " ".join(a), " ".join(b or ["z"])
        rows += [(2 * i, x), (2 * i + 1, y)]
        alike[2 * i, 2 * i + 1] = brute.close(x, y, int(0.2 * max(len(x), len(y)) + 1e-9))
    assert 20 < sum(alike.values()) < 110
    texts = spark.createDataFrame(rows, "lid long, norm string").localCheckpoint()
    pairs = spark.createDataFrame(list(alike), "a long, b long").localCheckpoint()
    found = lambda: {(r.a, r.b) for r in linededup.verified(pairs, texts, 0.8).collect()}
    assert found() == {p for p, yes in alike.items() if yes}
    monkeypatch.setattr(linededup.F, "call_function", lambda *a: F.lit(-1))  # no strings are compared
    assert len(found()) > 0.9 * sum(alike.values())
