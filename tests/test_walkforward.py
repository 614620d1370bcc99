"""Nested selection against plain loops over the same folds: fits, choices, refits, outer judgement."""

import math
from datetime import datetime, timedelta, timezone
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_core import make_bars
from tickloom.operators import backtest, boosting, bundles, walkforward
from tickloom.operators.splits import Block, Fold
from tickloom.session import in_utc
from tickloom.sources import inventory
from tickloom.sources.inventory import InventoryError

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
NAMES = ["momentum_5_bps", "candle_body_bps", "hour_sin"]
STEP, N, GAP = 10, 900, 16


def at(k):
    return datetime(2024, 1, 1) + timedelta(minutes=STEP * k)


FOLDS = [
    Fold(f"f{i}", Block(f"f{i}-train", at(0), at(e - 60)), Block(f"f{i}-cal", at(e - 60), at(e)), Block(f"f{i}-test", at(e), at(e + 150)),
         tuple((Block(f"f{i}-in{q}-train", at(0), at(e - q)), Block(f"f{i}-in{q}", at(e - q), at(e - q + 80))) for q in (220, 140)))
    for i, e in enumerate((500, 650))
]


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(N, 3)) * [5, 2, 0.7] + [1, 0, 0]
    r = 1.2 * x[:, 0] - 2 * x[:, 1] + rng.normal(size=N) * 8
    x[rng.random((N, 3)) < 0.05] = np.nan
    y = np.where(r < -6, 0, np.where(r > 6, 2, 1))
    return x, y, r


@pytest.fixture(scope="module")
def rows(spark, made):
    x, y, r = made
    t = [T0 + timedelta(minutes=STEP * k) for k in range(N)]
    data = [(f"s{k}", "I", "s", t[k], t[k] + timedelta(minutes=1), t[k] + timedelta(minutes=16), 15, 100.0, float(100.0 * (1 + r[k] / 1e4)), int(y[k]), float(r[k]), *[None if math.isnan(v) else float(v) for v in x[k]]) for k in range(N)]
    columns = "sample_id string, instrument string, source string, prediction_time_utc timestamp, entry_time_utc timestamp, label_end_time_utc timestamp, horizon_minutes int, entry_bid_open double, exit_bid_open double, target_class_id int, arithmetic_return_bps double, " + ", ".join(f"{n} double" for n in NAMES)
    return in_utc(spark).createDataFrame(data, columns)


def taken(block, purge):
    lo, hi = ((b - datetime(2024, 1, 1)) / timedelta(minutes=STEP) for b in (block.start, block.end))
    k = np.arange(N)
    return (k >= lo) & (k * STEP < hi * STEP - GAP) & (k * STEP + 16 < hi * STEP) if purge else (k >= lo) & (k < hi)


def prepared(x, train):
    median = np.nanmedian(x[train], axis=0)
    filled = np.where(np.isnan(x), median, x)
    return (filled - filled[train].mean(axis=0)) / filled[train].std(axis=0)


def plain_logistic(x, y, c, balanced):
    """Gradient descent with momentum to a small gradient: slow, and nothing of Newton's steps."""
    z, k = np.column_stack([x, np.ones(len(x))]), np.eye(3)[y]
    w = len(y) / (3 * np.bincount(y, minlength=3))[y] if balanced else np.ones(len(y))
    theta = speed = np.zeros((3, z.shape[1]))
    rate = 1 / (c * (w[:, None] * z**2).sum() / 2 + 1)
    for turn in range(60_000):
        ahead = theta + turn / (turn + 3) * speed
        e = np.exp(z @ ahead.T - (z @ ahead.T).max(axis=1, keepdims=True))
        slope = c * (w[:, None] * (e / e.sum(axis=1, keepdims=True) - k)).T @ z
        slope[:, :-1] += ahead[:, :-1]
        new = ahead - rate * slope
        theta, speed = new, new - theta
        if np.abs(slope).max() < 1e-7:
            break
    return theta


def plain_predict(family, value, balanced, x, y, r, train, test):
    z = prepared(x, train)
    if family == "ridge":
        m, b = z[train].mean(axis=0), r[train].mean()
        a = np.vstack([z[train] - m, math.sqrt(value) * np.eye(3)])
        slope = np.linalg.lstsq(a, np.append(r[train] - b, np.zeros(3)), rcond=None)[0]
        expected = (z[test] - m) @ slope + b
        sigma = np.std(r[train] - (z[train] - m) @ slope - b)
        low, high = (math.expm1(s * 6 / 1e4) * 1e4 for s in (-1, 1))
        phi = lambda v: np.array([0.5 * (1 + math.erf(u / math.sqrt(2))) for u in v])
        down, below = phi((low - expected) / sigma), phi((high - expected) / sigma)
        return np.column_stack([down, below - down, 1 - below]), expected
    theta = plain_logistic(z[train], y[train], value, balanced)
    said = np.column_stack([z[test], np.ones(test.sum())]) @ theta.T
    p = np.exp(said) / np.exp(said).sum(axis=1, keepdims=True)
    return p, p @ [r[train][y[train] == c].mean() for c in range(3)]


def scores(p, expected, y, r):
    said, f1 = p.argmax(axis=1), []
    for c in range(3):
        both, either = ((said == c) & (y == c)).sum(), (said == c).sum() + (y == c).sum()
        f1.append(2 * both / either if either else 0.0)
    return np.mean(f1), -np.log(p[np.arange(len(y)), y]).mean(), np.abs(r - expected).mean()


CANDIDATES = {"logistic": (0.01, 1.0), "ridge": (0.1, 1000.0)}


@pytest.fixture(scope="module")
def nested(rows):
    return walkforward.nested_selection(rows, FOLDS, NAMES, GAP, CANDIDATES, balanced=(False, True), costs=backtest.Costs(0.0, 0.0), policies=(backtest.Policy(0.4, 0.0), backtest.Policy(0.5, 1.0)), minimum_trades=2)


@pytest.fixture(scope="module")
def plain(made):
    x, y, r = made
    specs = [("logistic", v, b) for v in CANDIDATES["logistic"] for b in (False, True)] + [("ridge", v, True) for v in CANDIDATES["ridge"]]
    inner = {(f.name, block.name, s): scores(*plain_predict(*s, x, y, r, taken(block, True), taken(val, False)), y[taken(val, False)], r[taken(val, False)]) for f in FOLDS for block, val in f.inner for s in specs}
    chosen = {}
    for f in FOLDS:
        for family in CANDIDATES:
            mean = {s: np.mean([inner[f.name, b.name, s] for b, _ in f.inner], axis=0) for s in specs if s[0] == family}
            chosen[f.name, family] = min(mean, key=(lambda s: mean[s][2]) if family == "ridge" else (lambda s: (-mean[s][0], mean[s][1])))
    return inner, chosen


def test_all_candidates_match_plain_fits(nested, plain):
    got = {(s.fold, s.block, (s.family, s.value, s.balanced)): (s.macro_f1, s.log_loss, s.return_mae_bps) for s in nested.scores.collect()}
    assert got.keys() == plain[0].keys()
    for k, want in plain[0].items():
        assert got[k] == pytest.approx(want, abs=2e-6), k


def test_the_choice_is_that_of_a_plain_loop(nested, plain):
    assert {(c.fold, c.family): (c.family, c.value, c.balanced) for c in nested.chosen.collect()} == plain[1]


def test_refit_and_outer_report(nested, plain, made):
    x, y, r = made
    report = {(s.fold, s.family): s for s in nested.report.collect()}
    assert report.keys() == plain[1].keys()
    for f in FOLDS:
        for family in CANDIDATES:
            test, s = taken(f.test, False), report[f.name, family]
            p, expected = plain_predict(*plain[1][f.name, family], x, y, r, taken(f.train, True), test)
            assert (s.macro_f1, s.log_loss, s.return_mae_bps) == pytest.approx(scores(p, expected, y[test], r[test]), abs=2e-6)
            assert s.n == test.sum() and s.accuracy == pytest.approx((p.argmax(axis=1) == y[test]).mean())
            bucket, gap = np.minimum((p.max(axis=1) * 10).astype(int), 9), 0.0
            for b in set(bucket):
                m = bucket == b
                gap += m.sum() * abs(p.max(axis=1)[m].mean() - (p.argmax(axis=1) == y[test])[m].mean())
            assert s.calibration_error == pytest.approx(gap / test.sum(), abs=2e-6)
            trades = nested.predictions.filter((F.col("fold") == f.name) & (F.col("family") == family) & (F.col("decision_status") == "executed")).collect()
            assert s.trades == len(trades) and s.net_bps == pytest.approx(sum(t.net_return_bps for t in trades)) and s.turnover == 2 * s.trades
            assert (s.policy == -1) == (s.trades == 0)
    assert any(s.trades for s in report.values())


def test_models_outlive_json(nested, made):
    for m in nested.models:
        again = walkforward.Model.from_json(m.to_json())
        assert again.cell == m.cell and all((a == b).all() for a, b in zip(again.predict(made[0]), m.predict(made[0]), strict=True))
        assert m.trained_to < f"{FOLDS[[f.name for f in FOLDS].index(m.cell.block.split('-')[0])].train.end}"


def test_equals_go_to_the_simpler_candidate(spark):
    rows = [("f", "logistic", v, w, b, 0.5, 1.0, 2.0) for v in (0.1, 1.0, 10.0) for w in (True, False) for b in ("a", "b")] + [("f", "ridge", v, True, "a", v, 1.0, e) for v, e in ((0.1, 3.0), (10.0, 2.0), (1000.0, 2.0))]
    got = walkforward.choose(spark.createDataFrame(rows, "fold string, family string, value double, balanced boolean, block string, macro_f1 double, log_loss double, return_mae_bps double")).collect()
    assert {(r.family, r.value, r.balanced) for r in got} == {("logistic", 1.0, False), ("ridge", 10.0, True)}


def test_what_cannot_be_fitted_is_refused(rows):
    with pytest.raises(ValueError, match="no allowed set"):
        walkforward.marked_blocks(rows, FOLDS, ["target_class_id"], GAP)
    with pytest.raises(ValueError, match="lacks a class"):
        walkforward.nested_selection(rows.filter("target_class_id < 2"), FOLDS[:1], NAMES, GAP, CANDIDATES)
    with pytest.raises(ValueError, match="no rows to train"):
        walkforward.nested_selection(rows.limit(0), FOLDS[:1], NAMES, GAP, CANDIDATES)


def test_promotion_is_by_every_gate(spark):
    base = {"macro_f1": (0.4, 0.38), "brier": (0.6, 0.62), "trades": (50.0, 40.0), "net_bps": (5.0, 1.0), "stress_net_bps": (1.0, -3.0)}
    cases = {
        "reference": base, "same": base, "better": base | {"macro_f1": (0.41, 0.38)}, "few": base | {"macro_f1": (0.41, 0.39), "trades": (30.0, 19.0)},
        "loses": base | {"macro_f1": (0.41, 0.39), "net_bps": (5.0, -0.1)}, "empty": {k: (None, None) for k in base},
    }
    frame = spark.createDataFrame([(f, m, *v) for f, ms in cases.items() for m, v in ms.items()], "family string, metric string, mean double, worst double")
    got = {r.family: r for r in walkforward.promotion(frame).collect()}
    assert {f for f, r in got.items() if r.promoted} == {"better"} and got["same"].failed == "macro_f1 mean over reference" and got["few"].failed == "trades worst at least 20.0"
    assert got["loses"].n_passed == 5 and got["empty"].n_passed == 0 and "reference" not in got


# bundles, inventories, reproduction


def test_bundles_reload_to_the_same_scores_and_refuse_others(spark, nested, rows, made, tmp_path):
    root, to = f"file://{tmp_path}/bundles", max(m.trained_to for m in nested.models)
    path = bundles.save_bundle(spark, root, nested.models, NAMES, "v1", to)
    assert bundles.latest(spark, root) == path
    load = lambda names=NAMES, version="v1", as_of="2024-01-08 00:00:00", days=30: bundles.load_bundle(spark, path, names, version, as_of, days)
    models = load()
    assert [m.cell for m in models] == [m.cell for m in nested.models]
    for a, b in zip(models, nested.models, strict=True):
        assert all((x == y).all() for x, y in zip(a.predict(made[0]), b.predict(made[0]), strict=True))
    for refused, match in (({"names": NAMES[::-1]}, "other features"), ({"version": "v2"}, "trained on v1"), ({"as_of": "2024-03-08 00:00:00"}, "days old"), ({"as_of": "2024-01-02 00:00:00"}, "comes after")):
        with pytest.raises(InventoryError, match=match):
            load(**refused)
    universe = rows.filter(F.col("sample_id").endswith("7")).select("sample_id")
    again = bundles.reevaluate(models, rows, universe)
    assert again.count() == len(models) * universe.count()
    row = again.filter("model = 1 AND sample_id = 's417'").first()
    assert row.p_up == models[1].predict(made[0][417:418])[0][0, 2]
    with pytest.raises(Exception, match="(?i)exists"):
        bundles.save_bundle(spark, root, nested.models, NAMES, "v1", to)


def test_a_changed_bundle_is_refused_by_file(spark, nested, tmp_path):
    to = max(m.trained_to for m in nested.models)
    for k, harm in enumerate((lambda p: p.unlink(), lambda p: p.write_bytes(p.read_bytes() + b"x"), lambda p: (p.parent / "part-more.parquet").write_bytes(b"y"))):
        path = bundles.save_bundle(spark, f"file://{tmp_path}/b{k}", nested.models, NAMES, "v1", to)
        victim = next(Path(path.removeprefix("file://")).glob("content/models/*.parquet"))
        (victim.parent / f".{victim.name}.crc").unlink()  # a local file system's own check
        harm(victim)
        with pytest.raises(InventoryError, match=("missing: models/part-", "changed: models/part-", "added: models/part-more")[k]):
            bundles.load_bundle(spark, path, NAMES, "v1", "2024-01-08 00:00:00", 30)
    path = Path(bundles.save_bundle(spark, f"file://{tmp_path}/b9", nested.models, NAMES, "v1", to).removeprefix("file://"))
    text = (path / "manifest.json").read_text()
    for crc in path.glob(".manifest.json*"):
        crc.unlink()
    (path / "manifest.json").write_text(text.replace('"v1"', '"v2"'))
    with pytest.raises(InventoryError, match="manifest was changed"):
        bundles.load_bundle(spark, f"file://{path}", NAMES, "v2", "2024-01-08 00:00:00", 30)


def test_pipelines_are_bundled_too(spark, rows, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    model = Pipeline(stages=[Imputer(inputCols=NAMES, outputCols=[f"{n}_i" for n in NAMES]), VectorAssembler(inputCols=[f"{n}_i" for n in NAMES], outputCol="features"), LinearRegression(labelCol="arithmetic_return_bps", solver="normal")]).fit(rows)
    path = bundles.save_bundle(spark, f"file://{tmp_path}/p", model, NAMES, "v1", "2024-01-02 00:00:00")
    again = bundles.load_bundle(spark, path, NAMES, "v1", "2024-01-08 00:00:00", 30)
    assert again.transform(rows).select("sample_id", "prediction").exceptAll(model.transform(rows).select("sample_id", "prediction")).count() == 0


def test_files_are_told_apart_by_content_and_paths_kept_inside(spark, tmp_path):
    for name, text in (("a", "1"), ("d/b", "2"), ("d/c", "3"), ("d/new", "4"), ("_hidden", "5")):
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(text)
    there = inventory.files(spark, f"{tmp_path}/r")
    assert {r.path: r.length for r in there.collect()} == {"a": 1, "d/b": 1, "d/c": 1, "d/new": 1}
    digest = dict(there.select("path", "sha256").collect())
    listed = [("a", 1, digest["a"].upper()), ("d/b", 1, digest["a"]), ("d/c", 2, digest["d/c"]), ("gone", 1, "x"), ("../a", 1, digest["a"]), ("/etc/x", 1, "x"), ("d/../a", 1, "x"), ("file:x", 1, "x"), ("gone2", 1, "x"), ("gone2", 1, "x"), (None, 1, "x")]
    got = {r.path: r.status for r in inventory.compared(spark.createDataFrame(listed, "path string, length long, sha256 string"), there).collect()}
    assert got == {"a": "same", "d/b": "changed", "d/c": "changed", "d/new": "added", "gone": "missing", "../a": "escapes", "/etc/x": "escapes", "d/../a": "escapes", "file:x": "escapes", "gone2": "repeated", "": "escapes"}


def test_layers_are_read_only_as_they_were_published(spark, tmp_path):
    bars = make_bars(spark, [datetime(2023, 12, 31, 23, 58) + timedelta(minutes=m) for m in range(6)])
    path = f"file://{tmp_path}/layer"
    said = inventory.publish_layer(bars, path, "curated", {"raw": "sha256:1"}, {"timeframe": "1min"})
    read = lambda **more: inventory.read_layer(spark, path, **more)
    assert said["body"]["years"] == [2023, 2024] and read(layer="curated", inputs={"raw": "sha256:1"}, years=[2023, 2024], first="2023-01-01", before="2025-01-01").drop("utc_year").exceptAll(bars).count() == 0
    for wrong, match in (({"layer": "raw"}, "layer curated"), ({"inputs": {"raw": "sha256:2"}}, "inputs"), ({"years": [2024]}, "years"), ({"first": "2024-01-01"}, "2 before"), ({"before": "2024-01-01"}, "4 from")):
        with pytest.raises(InventoryError, match=match):
            read(**wrong)
    stray = next((tmp_path / "layer/content/utc_year=2023").glob("part-*"))
    moved = tmp_path / "layer/content/utc_year=2024" / stray.name
    stray.rename(moved)
    with pytest.raises(InventoryError, match="missing: utc_year=2023.*added: utc_year=2024|added: utc_year=2024.*missing"):
        read()
    with pytest.raises(InventoryError, match="missing: x"):
        inventory.require_provenance(spark, f"{tmp_path}/layer/content", inventory.files(spark, f"{tmp_path}/layer/content").unionByName(spark.createDataFrame([("x", 1, "y")], "path string, length long, sha256 string")))


def test_a_recorded_run_is_reproduced(spark, nested, rows, tmp_path):
    path = f"file://{tmp_path}/run"
    bundles.record_run(spark, path, rows, nested, FOLDS, NAMES, GAP)
    r = bundles.reproduce_run(spark, path, FOLDS).first()
    assert (r.n_other_choices, r.n_other_models, r.n_other_keys, r.n_far) == (0, 0, 0, 0) and r.n_rows == 2 * 300 and r.largest < 1e-11
    with pytest.raises(InventoryError, match="other folds"):
        bundles.reproduce_run(spark, path, FOLDS[:1])
    again = bundles.reproduce_run(spark, path, FOLDS).first()
    assert again == r  # sums are added in one order


def test_differences_count_both_sides(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("y", 2.0), ("z", 3.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 3.5), ("w", 0.0)], "k string, v double")
    r = bundles.differences(a, b, ["k"], ["v"], 0.1).first()
    assert (r.n_rows, r.n_other_keys, r.n_only_saved, r.n_only_again, r.largest, r.n_far) == (4, 2, 2, 2, 0.5, 1)


# boosted trees


def plain_boosting(x, y, edges, rounds, depth, rate, penalty=1.0, least=1.0):
    """Trees by recursion over row numbers; every split tried."""
    margins, out = np.zeros((len(x), 3)), []

    def grow(rows, g, h, level):
        value = -rate * g[rows].sum() / (h[rows].sum() + penalty)
        best = (1e-12, None)
        if level < depth:
            score = lambda r: g[r].sum() ** 2 / (h[r].sum() + penalty)
            for i in range(x.shape[1]):
                for e in sorted(set(edges[i])):
                    a, b = rows[x[rows, i] <= e], rows[x[rows, i] > e]
                    if min(h[a].sum(), h[b].sum()) >= least and (gain := score(a) + score(b) - score(rows)) > best[0] + 1e-9:
                        best = (gain, (i, e, a, b))
        if best[1] is None:
            return lambda v: value
        i, e, a, b = best[1]
        low, high = grow(a, g, h, level + 1), grow(b, g, h, level + 1)
        return lambda v: low(v) if v[i] <= e else high(v)

    for _ in range(rounds):
        p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        trees = [grow(np.arange(len(x)), p[:, k] - (y == k), 2 * p[:, k] * (1 - p[:, k]), 0) for k in range(3)]
        margins += np.array([[t(v) for t in trees] for v in x])
        out.append(trees)
    return margins, out


def test_boosted_trees_match_plain_ones_and_stop_on_the_validation_block(rows, made):
    x, y, r = made
    blocks = walkforward.marked_blocks(rows, FOLDS[:1], NAMES, GAP, allowed=NAMES)
    name = FOLDS[0].inner[0][0].name
    train, test = taken(FOLDS[0].inner[0][0], True), taken(FOLDS[0].inner[0][1], False)
    median = np.nanmedian(x[train], axis=0)
    full = np.where(np.isnan(x), median, x)
    model = boosting.fit_boosted(blocks, name, depth=2, most=3, rate=0.5, bins=8, patience=None)
    edges = boosting.bin_edges(blocks, name, median, 8)
    margins, trees = plain_boosting(full[train], y[train], edges, 3, 2, 0.5)
    assert np.allclose(model.margins(full[train]), margins, atol=1e-9)
    said = np.array([[sum(t[k](v) for t in trees) for k in range(3)] for v in full[test]])
    p = np.exp(said) / np.exp(said).sum(axis=1, keepdims=True)
    assert np.allclose(model.predict(x[test]), p, atol=1e-9) and len(model.losses) == 4 and len(model.rounds) == 3
    assert model.losses[-1] == pytest.approx(-np.log(p[np.arange(len(p)), y[test]]).mean()) and model.losses[0] == pytest.approx(math.log(3))
    stopped = boosting.fit_boosted(blocks, name, depth=2, most=30, rate=1.0, bins=8, patience=2)
    best = int(np.argmin(stopped.losses))
    assert len(stopped.rounds) == best and len(stopped.losses) == best + 3 and stopped.losses[best] < stopped.losses[0]
    with pytest.raises(ValueError, match="lacks a class"):
        boosting.fit_boosted(walkforward.marked_blocks(rows.filter("target_class_id < 2"), FOLDS[:1], NAMES, GAP, allowed=NAMES), name)
