import io
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.functions.bars import class_probabilities, huber, normal_cdf, pinball
from tickloom.operators import asof, backtest, labels, metrics, models, paths, resample, splits, validate
from tickloom.operators.features import mvp_features
from tickloom.schema import BARS
from tickloom.session import in_utc
from tickloom.sources import archives, tables
from tickloom.streaming import bars as stream

T0 = datetime(2024, 1, 1)


def make_bars(spark, opens, minutes=1, timeframe="1min", instrument="I"):
    rows = []
    for i, t in enumerate(opens):
        o = 2000 + 0.25 * i
        rows.append((instrument, "s", timeframe, t, t + timedelta(minutes=minutes), o, o + 1.5, o - 1.0, o + 0.5, True, "h", datetime(2026, 1, 1), "v"))
    return in_utc(spark).createDataFrame(rows, BARS)


def run_of(n, start=T0, minutes=1):
    return [start + timedelta(minutes=minutes * i) for i in range(n)]


def test_contract_accepts_and_rejects(spark):
    good = make_bars(spark, run_of(5))
    assert validate.validate_bars(good, "1min").count() == 5
    for bad, match in ((good.withColumn("bid_high", F.lit(1.0)), "invalid_ohlc"), (good.withColumn("bid_open", F.lit(float("nan"))), "invalid_ohlc"), (good.unionByName(good), "repeated_keys"), (good.withColumn("source", F.lit(" ")), "blank_text"), (good.withColumn("timestamp_close_utc", F.col("timestamp_open_utc")), "off_grid"), (good.withColumn("is_complete", F.lit(None).cast("boolean")), "not_complete"), (good.drop("source"), "missing columns"), (good.withColumn("timestamp_open_utc", F.col("timestamp_open_utc").cast("timestamp_ntz")), "without a zone"), (good.withColumn("bid_low", F.lit("9")), "not numbers")):
        with pytest.raises(validate.BarContractError, match=match):
            validate.validate_bars(bad, "1min")
    assert validate.validate_bars(good.unionByName(good), "1min", "drop_identical").count() == 5
    with pytest.raises(validate.BarContractError, match="other_timeframe"):
        validate.validate_bars(good, "3min")


def test_months_follow_the_calendar(spark):
    feb = make_bars(spark, [datetime(2024, 2, 1) + timedelta(days=i) for i in range(29)], 1440, "1d")
    month = resample.resample(feb, "1mo", "1d").first()
    assert (month.timestamp_open_utc, month.timestamp_close_utc) == (datetime(2024, 2, 1), datetime(2024, 3, 1)) and month.bid_close == 2007.5
    assert resample.resample(feb.filter("timestamp_open_utc <> TIMESTAMP '2024-02-10'"), "1mo", "1d").count() == 0
    two = make_bars(spark, [datetime(2024, 1, 1), datetime(2024, 4, 1)], 1440 * 31, "1mo").withColumn("timestamp_close_utc", F.add_months(F.col("timestamp_open_utc").cast("date"), 1).cast("timestamp"))
    assert [r.missing_bars for r in validate.gaps(two, "1mo").collect()] == [2]


def test_incomplete_and_open_windows_are_left_out(spark):
    bars = make_bars(spark, run_of(9)).withColumn("is_complete", F.col("timestamp_open_utc") != F.lit(T0 + timedelta(minutes=4)))
    assert [r.timestamp_open_utc.minute for r in resample.resample(bars, "3min").orderBy("timestamp_open_utc").collect()] == [0, 6]
    assert resample.resample(bars, "3min", closed_through=F.lit(T0 + timedelta(minutes=8)).cast("timestamp")).count() == 1


def test_features_need_full_frames(spark):
    assert mvp_features(make_bars(spark, run_of(30, minutes=3), 3, "3min")).count() == 10
    gap = run_of(15, minutes=3) + run_of(15, T0 + timedelta(minutes=60), 3)
    assert mvp_features(make_bars(spark, gap, 3, "3min")).count() == 0


def test_features_do_not_see_the_future(spark):
    bars = make_bars(spark, run_of(40, minutes=3), 3, "3min")
    early = T0 + timedelta(minutes=3 * 30)
    cut = mvp_features(bars.filter(F.col("timestamp_close_utc") <= F.lit(early)))
    assert cut.exceptAll(mvp_features(bars).filter(F.col("prediction_time_utc") <= F.lit(early))).count() == 0


def test_asof_takes_an_older_bar_but_not_a_stale_one(spark):
    left = in_utc(spark).createDataFrame([("I", "s", T0 + timedelta(minutes=m)) for m in (14, 15, 20, 30, 45, 46)], "instrument string, source string, prediction_time_utc timestamp")
    right = spark.createDataFrame([("I", "s", T0 + timedelta(minutes=15), 1.0), ("I", "s", T0 + timedelta(minutes=30), 2.0)], "instrument string, source string, available_at_utc timestamp, x double")
    late = right.filter("x = 1.0")
    for f in (lambda r: asof.asof_on_grid(left, r, "15min", ["x"]), lambda r: asof.asof_general(left, r, ["x"], 900)):
        assert [r.x for r in f(right).orderBy("prediction_time_utc").collect()] == [None, 1.0, 1.0, 2.0, 2.0, None]
        assert [r.x for r in f(late).orderBy("prediction_time_utc").collect()] == [None, 1.0, 1.0, 1.0, None, None]


def test_labels_are_exact_and_guarded(spark):
    bars = make_bars(spark, run_of(40))
    ask = bars.filter(F.minute("timestamp_open_utc") % 3 == 0).select("instrument", "source", F.col("timestamp_open_utc").alias("prediction_time_utc"))
    got = labels.build_labels(bars, ask, (15,))
    assert got.count() == sum(1 for m in range(0, 40, 3) if m + 16 < 40)
    row = got.orderBy("prediction_time_utc").first()
    assert row.entry_time_utc == T0 + timedelta(minutes=1) and row.exit_bid_open == 2004.0 and row.target_class == "up"
    assert labels.build_labels(bars, ask, (15,), guard="2024-01-01 00:20:00").count() == 2
    assert labels.build_labels(bars, ask, threshold_bps=1e6).filter("target_class = 'neutral'").count() == got.count()


def test_folds_expand_and_blocks_purge(spark):
    folds = splits.calendar_folds()
    assert [f.test.start.year for f in folds] == [2022, 2023, 2024] and folds[1].train.end == datetime(2022, 10, 1) and len(folds[0].inner) == 2
    assert splits.required_gap_minutes(labels.HORIZONS) == 181
    rows = in_utc(spark).createDataFrame([(T0 + timedelta(minutes=m), T0 + timedelta(minutes=m + 16)) for m in range(0, 120, 10)], "prediction_time_utc timestamp, label_end_time_utc timestamp")
    b = splits.Block("b", T0, T0 + timedelta(minutes=60))
    assert splits.select_block(rows, b, 31).count() == 3 and splits.select_block(rows, b, 31, purge=False).count() == 6
    with pytest.raises(ValueError, match="label_end"):
        splits.require_before(rows, T0 + timedelta(minutes=120))
    with pytest.raises(ValueError):
        splits.Block("empty", T0, T0)


def trades(spark, spans, instrument="I"):
    rows = [(instrument, "s", T0 + timedelta(minutes=a - 1), T0 + timedelta(minutes=a), T0 + timedelta(minutes=b), b - a, 0.1, 0.1, 0.8, 10.0, 100.0, 101.0, 99.0) for a, b in spans]
    return in_utc(spark).createDataFrame(rows, "instrument string, source string, prediction_time_utc timestamp, entry_time_utc timestamp, label_end_time_utc timestamp, horizon_minutes int, p_down double, p_neutral double, p_up double, expected_return_bps double, entry_bid_open double, exit_bid_open double, future_return_bps double")


def test_trades_do_not_overlap_and_may_touch(spark):
    spans = [(10, 25), (13, 28), (25, 40), (39, 54), (60, 75), (1430, 1445), (1441, 1456), (1445, 1460), (3000, 3015)]
    done = backtest.run_backtest(trades(spark, spans).unionByName(trades(spark, [(12, 27)], "J")))
    got = {(r.instrument, int((r.entry_time_utc - T0).total_seconds() // 60)) for r in done.filter("decision_status = 'executed'").collect()}
    assert got == {("I", m) for m in (10, 25, 60, 1430, 1445, 3000)} | {("J", 12)}
    assert done.filter("decision_status = 'suppressed_overlap'").count() == 3


def test_fills_match_hand_figures(spark):
    r = backtest.run_backtest(trades(spark, [(10, 25)]), backtest.Costs(3.0, 0.5, 0.2)).first()
    entry, exit_ = 100.03 * 1.00005, 101 * 0.99995
    assert abs(r.entry_fill_price - entry) < 1e-9 and abs(r.net_return_bps - ((exit_ - entry) * 100 - 0.4)) < 1e-9
    assert backtest.trade_summary(backtest.run_backtest(trades(spark, [(10, 25)]), policy=backtest.Policy(0.9))).first().n_trades == 0


def test_reconstruction_and_scalars(spark):
    p = paths.rebuilt(paths.future_paths(make_bars(spark, run_of(12, minutes=3), 3, "3min")))
    assert p.count() == 7 and p.filter("abs(rebuilt_close - agg_close) > 1e-6 OR abs(rebuilt_high - agg_high) > 1e-6").count() == 0
    x = in_utc(spark).range(1).select(normal_cdf(F.lit(0.0)).alias("a"), normal_cdf(F.lit(1.96)).alias("b"), pinball(0.9, F.lit(-2.0)).alias("c"), huber(F.lit(3.0), 1.0).alias("d"), *[v.alias(k) for k, v in class_probabilities(F.lit(0.0), 10.0, 6.0).items()]).first()
    assert abs(x.a - 0.5) < 1e-6 and abs(x.b - 0.975) < 1e-4 and abs(x.c - 0.2) < 1e-9 and x.d == 2.5 and abs(x.p_down + x.p_neutral + x.p_up - 1) < 1e-12 and abs(x.p_up - 0.274) < 2e-3


def archive(path, lines, name="DAT_ASCII_XAUUSD_M1_2024.csv"):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr(name, "\n".join(lines))


def test_archives(spark, tmp_path):
    in_utc(spark)
    rows = ["20240101 000000;1;2;0.5;1.5;0", "20240101 000000;1;2;0.5;1.5;0", "20240101 000100;1;2;0.5;1.5;0"]
    archive(tmp_path / "a.zip", rows)
    got = archives.ingest(spark, f"file://{tmp_path}/a.zip", 2024, "2026-01-01").orderBy("timestamp_open_utc").collect()
    assert len(got) == 2 and got[0].timestamp_open_utc == datetime(2024, 1, 1, 5) and len(got[0].raw_file_hash) == 64
    for extra, match in (("20240101 000030;1;2;1;1;0", "malformed"), ("20240101 000100;9;9;9;9;0", "different bars"), ("20250101 000000;1;2;0.5;1.5;0", "outside")):
        archive(tmp_path / "b.zip", [*rows, extra])
        with pytest.raises(Exception, match=match):
            archives.ingest(spark, f"file://{tmp_path}/b.zip", 2024, "2026-01-01")
    (tmp_path / "c.zip").write_bytes(b"no archive" + io.BytesIO().getvalue())
    with pytest.raises(Exception, match="zip"):
        archives.scan_archives(spark, f"file://{tmp_path}/c.zip").count()


def test_update_plan():
    day = lambda d: datetime(2024, 1, d)
    r = [archives.Resource(f"r{i}", day(i), day(i + 1)) for i in range(1, 6)]
    assert [x.name for x in archives.plan_update(iter([r[3:], r[:3]]), {"r2"}, day(1), day(9), day(9))] == ["r1", "r3", "r4", "r5"]
    for pages, guard in (([r, r[:1]], day(9)), ([r, [archives.Resource("x", day(1), day(3))]], day(9)), ([r], day(3))):
        with pytest.raises(ValueError):
            archives.plan_update(iter(pages), set(), day(1), day(9), guard)
    with pytest.raises(ValueError):
        archives.create_provider("nowhere")


def test_published_tables_are_checked(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    bars = make_bars(spark, run_of(5))
    said = tables.publish(bars, path, "curated", {"raw": "sha256:1"}, {"a": 1})
    assert said["rows"] == 5 and tables.read_published(spark, path).count() == 5
    make_bars(spark, run_of(1, T0 + timedelta(days=1))).withColumn("utc_year", F.lit(2024)).write.mode("append").partitionBy("utc_year").parquet(f"{path}/table")
    with pytest.raises(ValueError, match="manifest says"):
        tables.read_published(spark, path)
    assert tables.content_version({"b": 1, "a": 2}) == tables.content_version({"a": 2, "b": 1})
    with pytest.raises(ValueError):
        tables.canonical({"x": float("nan")})
    assert tables.markdown(bars.select("instrument", "bid_open").limit(1), "T").startswith("# T\n\n| instrument | bid_open |")


def test_streams_equal_batches(spark, tmp_path):
    opens = [t for t in run_of(60) if t.minute not in (7, 31)]
    bars = make_bars(spark, opens)
    for i, part in enumerate((bars.filter("minute(timestamp_open_utc) < 30"), bars.filter("minute(timestamp_open_utc) >= 25"), make_bars(spark, [T0 + timedelta(hours=9)]))):
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/p{i}")
    source = lambda: stream.read_bars(spark, f"file://{tmp_path}/in/*")
    stream.run_available(stream.tumbling_ohlc(stream.without_repeats(source(), "2 hours"), "3min", late=None), f"{tmp_path}/o1", f"{tmp_path}/c1")
    got = spark.read.parquet(f"{tmp_path}/o1")
    want = resample.resample(bars, "3min").select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    stream.run_available(stream.sessions(stream.without_repeats(source(), "2 hours"), late=None), f"{tmp_path}/o2", f"{tmp_path}/c2")
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/o2").collect()) == [7, 23, 28]


def test_stream_positions(spark, tmp_path):
    spans = [(10, 25), (13, 28), (25, 40), (39, 54)]
    rows = trades(spark, spans).select("instrument", "prediction_time_utc", "entry_time_utc", "label_end_time_utc", "horizon_minutes")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream.run_available(stream.positions(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")), f"{tmp_path}/o", f"{tmp_path}/c")
    assert [r.executed for r in spark.read.parquet(f"{tmp_path}/o").orderBy("prediction_time_utc").collect()] == [True, False, True, False]


def test_models_score_probabilities(spark):
    rows = in_utc(spark).range(240).select(F.col("id").alias("sample_id"), ((F.col("id") % 3).cast("double") + (F.col("id") % 7) / 20).alias("x"), (F.col("id") % 5).cast("double").alias("z"), (F.col("id") % 3).cast("int").alias("target_class_id"), ((F.col("id") % 3) * 10.0 - 10).alias("arithmetic_return_bps"))
    ready = models.prepare(rows, rows, ["x", "z"])
    scored = models.score_classes(models.fit_logistic(ready, ["x", "z"], 10.0, allowed=["x", "z"]), ready)
    assert scored.filter("abs(p_down + p_neutral + p_up - 1) > 1e-9").count() == 0 and scored.filter("target_class_id = 2 AND p_up > p_down").count() == 80
    ridge, sigma = models.fit_ridge(ready, ["x", "z"], 0.1, allowed=["x", "z"])
    assert models.score_ridge(ridge, sigma, ready).filter("target_class_id = 0 AND p_down < p_up").count() == 0
    with pytest.raises(ValueError, match="future"):
        models.fit_ridge(ready, ["x", "future_return_bps"], allowed=["x"])
    with pytest.raises(ValueError, match="share"):
        models.require_disjoint(rows, rows.limit(5))


def test_digests_by_tree(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 990, "a").otherwise("b").alias("g"), F.format_string("k%05d", "id").alias("k"), F.xxhash64("id").cast("string").alias("v"))
    digest = lambda r, fan=8: {x.g: (x.n, x.digest) for x in metrics.ordered_digest(r, "k", "v", ["g"], fan).collect()}
    base = digest(rows)
    assert base == digest(rows.orderBy(F.rand(1)).repartition(7)) and base["a"][0] == 990 and base["b"][0] == 10
    swapped = rows.withColumn("k", F.when(F.col("k") == "k00500", "k00501").when(F.col("k") == "k00501", "k00500").otherwise(F.col("k")))
    assert digest(swapped)["a"] != base["a"] and digest(swapped)["b"] == base["b"]
    assert digest(rows.filter("g = 'b'"))["b"] == base["b"]  # whatever other groups hold
    import hashlib

    level = [v for _, v in sorted((r.k, r.v) for r in rows.filter("g = 'a'").collect())]
    first = True
    while first or len(level) > 1:
        level = [hashlib.sha256("".join(x + "\n" for x in level[i : i + 8]).encode()).hexdigest() for i in range(0, len(level), 8)]
        first = False
    assert base["a"][1] == level[0]
    odd = spark.createDataFrame([(None, "a", None), (None, "b", "x")], "g string, k string, v string")
    assert digest(odd)[None] == (2, hashlib.sha256(b"\nx\n").hexdigest()) and not digest(odd.limit(0))


def test_gaps_across_days(spark):
    bars = make_bars(spark, [T0 + timedelta(minutes=m) for m in (0, 1, 1439, 1440, 4400, 4402)])
    assert sorted((int((r.gap_start_utc - T0).total_seconds() // 60), r.missing_bars) for r in validate.gaps(bars, "1min").collect()) == [(2, 1437), (1441, 2959), (4401, 1)]


def test_scaling_and_its_inverse(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (2.0, None), (4.0, 5.0), (None, 5.0)], "x double, y double")
    stats = splits.impute_scale_stats(rows, ["x", "y"])
    got = {r.feature: (r["median"], r["mean"], r["scale"]) for r in stats.collect()}
    assert got["x"] == pytest.approx((2.0, 2.25, 1.0897247358851685)) and got["y"] == (5.0, 5.0, 1.0)
    back = splits.unstandardized(splits.standardized(rows, stats, ["x", "y"]), stats, ["x", "y"])
    assert [tuple(r) for r in back.collect()] == [pytest.approx(t) for t in ((1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (2.0, 5.0))]


def test_entry_works_with_the_corpus_folders_deleted(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    here = pathlib.Path(__file__).parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(here, copy, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__", "corpus_pipeline.py") or n == "llm"])
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') for k in e.queries()), 'pipeline' in e.queries())"], cwd=copy, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    n, m, *corpus = said.stdout.split()
    assert int(n) > 100 and int(m) > 100 and corpus == ["False", "False"], said.stderr


def test_library_stands_without_the_corpus_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "tickloom"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "tickloom.llm" in p.read_text()]


def test_label_paths_are_made_rows_after_the_last_exchange(spark):
    """Eight horizons cost no exchange of eight rows a bar, and candidates that repeat keep their rows."""
    bars = make_bars(spark, run_of(200))
    ask = spark.createDataFrame([("I", "s", T0 + timedelta(minutes=m)) for m in (5, 5, 9, 190)], "instrument string, source string, prediction_time_utc timestamp").withColumns({c: F.lit(bars.first()[c]) for c in ("instrument", "source")})
    found = labels.build_labels(bars, ask, labels.HORIZONS)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")
    rows = [(int((r.prediction_time_utc - T0).total_seconds() // 60), r.horizon_minutes) for r in found.collect()]
    assert sorted(rows) == sorted([(m, h) for m in (5, 5, 9, 190) for h in labels.HORIZONS if m + 1 + h < 200])


def test_medians_from_brackets_are_exact(spark):
    """As F.percentile has it, by group, with nulls, ties, NaN, groups of one value and none, and no sketch of a group's different values."""
    from tickloom.operators import splits

    h = F.xxhash64("id") % 1_000_003
    rows = spark.range(30_001).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 != 0, h / 7.0).alias("a"), F.when(F.col("id") % 3 == 1, F.col("id") % 2).otherwise(h % 5).cast("double").alias("b"), F.when(F.col("id") % 3 != 2, F.when(F.col("id") % 2 == 0, float("nan")).otherwise(h)).alias("c"))
    rows = rows.unionByName(rows.limit(1).withColumn("g", F.lit(9).cast("long"))).unionByName(rows.limit(2).withColumn("g", F.lit(8).cast("long")))
    names = ["a", "b", "c"]
    got = splits.with_brackets(rows, names, ["g"]).groupBy("g").agg(*[splits.median(splits.bracketed(n)).alias(n) for n in names])
    want = rows.groupBy("g").agg(*[F.percentile(n, 0.5).alias(n) for n in names])
    assert got.count() == 5 and got.exceptAll(want).count() == 0
    assert "percentile(" not in splits.impute_scale_stats(rows, names)._jdf.queryExecution().optimizedPlan().toString()
