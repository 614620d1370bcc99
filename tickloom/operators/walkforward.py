"""Nested walk-forward selection: candidates fitted on inner blocks, chosen on inner validations, refitted, judged on outer tests.

A model is one cell: a training block and a candidate. All cells are fitted together over one written table: a pass adds up, for each
cell, what the next step needs (as many sums as the features ask for, whatever the rows), so a grid of any size takes as many passes as its
slowest cell. Logistic cells take Newton steps on C * sum(w * loss) + half the squared weights, which has one minimum; ridge
cells are solved from the moments of one pass, all penalties of a block from the same.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.bars import BPS, CLASSES
from tickloom.operators import backtest, metrics
from tickloom.operators.contracts import require_allowed
from tickloom.operators.features import FEATURES
from tickloom.operators.splits import Fold, bracketed, median, with_brackets
from tickloom.scratch import written

# The candidates of each family, C or the penalty.
CANDIDATES = {"reference": (0.1,), "logistic": (0.1, 1.0, 10.0), "ridge": (0.1, 10.0, 1000.0)}
CASH = backtest.Policy(2.0, 0.0)  # a confidence that none has
KEYS = ["sample_id", "instrument", "source", "prediction_time_utc", "entry_time_utc", "label_end_time_utc", "horizon_minutes", "entry_bid_open", "exit_bid_open"]
TARGETS = ["target_class_id", "arithmetic_return_bps"]


@dataclass(frozen=True)
class Cell:
    block: str
    family: str
    value: float
    balanced: bool = True


@dataclass
class Model:
    """A fitted cell: median, mean and scale of its training rows by feature, weights (a row a class, or one row; the last column is the
    constant), the mean return of each class and, for ridge, the deviation of the residuals."""

    cell: Cell
    names: list[str]
    prepare: np.ndarray
    weights: np.ndarray
    class_returns: np.ndarray
    sigma: float = 0.0
    trained_to: str = ""

    def predict(self, x: np.ndarray, threshold_bps: float = 6.0) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of down, neutral and up, and the expected arithmetic return in bps."""
        said = scaled(x, self.prepare) @ self.weights.T
        if self.cell.family == "ridge":
            low, high = (math.expm1(s * threshold_bps / BPS) * BPS for s in (-1, 1))
            below = [np.array([0.5 + 0.5 * math.erf(v) for v in ((bound - said[:, 0]) / (self.sigma * math.sqrt(2))).tolist()]) for bound in (low, high)]
            p = np.column_stack([below[0], below[1] - below[0], 1 - below[1]])
        else:
            p = softmax(said)
        p = np.clip(p, 1e-12, 1.0)
        p /= p.sum(axis=1, keepdims=True)
        return p, said[:, 0] if self.cell.family == "ridge" else p @ self.class_returns

    def to_json(self) -> str:
        return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v.__dict__ if isinstance(v, Cell) else v for k, v in self.__dict__.items()}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Model:
        plain = json.loads(text)
        return Model(**plain | {k: np.array(plain[k]) for k in ("prepare", "weights", "class_returns")} | {"cell": Cell(**plain["cell"])})


def scaled(x: np.ndarray, prepare: np.ndarray) -> np.ndarray:
    """Missing values become the median; all are scaled; a column of ones comes last."""
    median, mean, scale = prepare
    return np.column_stack([(np.where(np.isnan(x), median, x) - mean) / scale, np.ones(len(x))])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True, initial=-np.inf))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Blocks:
    """A written table of rows with their blocks as bits of two longs: bit k of mask_train says that the row trains the k-th block, of
    mask_test that it tests what the k-th block has trained."""

    table: DataFrame
    names: list[str]
    keys: list[str]
    trains: list[str]
    folds: list[Fold]

    def inner(self) -> dict[str, str]:
        """Inner training blocks and the folds they belong to."""
        return {train.name: f.name for f in self.folds for train, _ in f.inner}


def marked_blocks(rows: DataFrame, folds: list[Fold], names: list[str], gap_minutes: int, keys: list[str] = KEYS, allowed: list[str] = FEATURES) -> Blocks:
    """rows (names, keys, target_class_id, arithmetic_return_bps) with their blocks, written once. Training blocks are purged of what
    reaches past their end, tests are whole; rows of no block, as those reserved for calibration, are left out. Names that aren't allowed raise."""
    require_allowed(names, allowed)
    pairs = [pair for f in folds for pair in ((f.train, f.test), *f.inner)]
    if len(pairs) > 62 or len({train.name for train, _ in pairs}) < len(pairs):
        raise ValueError("at most 62 blocks, each with a name of its own")
    mask = lambda side, purge: sum([F.when(pair[side].predicate(gap_minutes, purge), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, pair in enumerate(pairs)], F.lit(0).cast("long"))
    found = rows.select(F.array(*[F.col(n).cast("double") for n in names]).alias("x"), *TARGETS, *keys, mask(0, True).alias("mask_train"), mask(1, False).alias("mask_test"))
    return Blocks(written(found.filter((F.col("mask_train") != 0) | (F.col("mask_test") != 0))), names, keys, [train.name for train, _ in pairs], folds)


def block_statistics(blocks: Blocks, names: list[str] | None = None) -> dict[str, dict]:
    """For each training block its rows, those of each class, their mean returns, its last label's end, and per feature the exact median of
    what is there and mean and population deviation of the imputed values (0 counts as 1). Two grouped passes; a row a block comes back."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(len(blocks.trains) - 1)), lambda k: F.getbit("mask_train", k) == 1)
    long = blocks.table.filter("mask_train != 0").select("x", *TARGETS, "label_end_time_utc", F.explode(bits).alias("block"))
    y, r = F.col("target_class_id"), F.col("arithmetic_return_bps")
    places = [f"x{i}" for i in range(len(blocks.names))]
    long = with_brackets(long.select("*", *[F.col("x")[i].alias(v) for i, v in enumerate(places)]).drop("x"), places, ["block"])
    medians = F.array(*[F.coalesce(median(bracketed(v)), F.lit(0.0)) for v in places])
    per = [F.coalesce(s.cast("double"), F.lit(0.0)) for v in places for s in (F.count(v), F.avg(v), F.stddev_pop(v))]
    classes = [F.count_if(y == c) for c in range(len(CLASSES))]
    returns = [F.coalesce(F.avg(F.when(y == c, r)), F.lit(0.0)) for c in range(len(CLASSES))]
    said = long.groupBy("block").agg(F.count("*").alias("n"), F.array(*classes).alias("classes"), F.array(*returns).alias("returns"), F.array(*per).alias("per"), medians.alias("medians"), F.date_format(F.max("label_end_time_utc"), "yyyy-MM-dd HH:mm:ss").alias("until"))
    found = {}
    for row in said.collect():
        there, mean, spread = np.array(row.per).reshape(-1, 3).T
        middle, share = np.array(row.medians), there / row.n
        whole = share * mean + (1 - share) * middle
        scale = np.sqrt(share * (spread**2 + (mean - whole) ** 2) + (1 - share) * (middle - whole) ** 2)
        found[blocks.trains[row.block]] = {"n": row.n, "classes": np.array(row.classes, dtype=float), "returns": np.array(row.returns), "prepare": np.array([middle, whole, np.where(scale > 0, scale, 1.0)]), "until": row.until}
    return found


def matrix(batch: pa.RecordBatch, features: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, features)


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def summed_cells(rows: DataFrame, size: int, cells: int, part: Callable[[Iterator[pa.RecordBatch], list[np.ndarray]], None]) -> dict[int, np.ndarray]:
    """Sums over rows, `size` numbers a cell: part() puts a task's share of the rows into its sums, and the tasks' sums, not more of them than twice
    the cluster's places, are added up a cell at a time, in the order of partitions: on the same rows and places the same to the last bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(size) for _ in range(cells)]
        part(batches, totals)
        place = np.full(cells, TaskContext.get().partitionId(), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(range(cells), pa.int32()), pa.array(place), pa.array(totals, pa.list_(pa.float64()))], names=["cell", "part", "sums"])

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("part")["sums"].to_list()
        return pd.DataFrame({"cell": frame["cell"].iloc[:1], "sums": [np.sum(np.stack(ordered), axis=0)]})

    places = 2 * rows.sparkSession.sparkContext.defaultParallelism
    found = rows.coalesce(places).mapInArrow(run, "cell int, part int, sums array<double>").groupBy("cell").applyInPandas(whole, "cell int, sums array<double>")
    return {r.cell: np.array(r.sums) for r in found.collect()}


def summed(blocks: Blocks, size: int, cells: int, add: Callable[[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]) -> dict[int, np.ndarray]:
    """summed_cells over all training rows: add() gets the sums so far and a batch's features, classes, returns and blocks."""
    features = len(blocks.names)

    def part(batches: Iterator[pa.RecordBatch], totals: list[np.ndarray]) -> None:
        for batch in batches:
            add(totals, matrix(batch, features), numbers(batch, "target_class_id"), numbers(batch, "arithmetic_return_bps"), numbers(batch, "mask_train"))

    return summed_cells(blocks.table.filter("mask_train != 0").select("x", *TARGETS, "mask_train"), size, cells, part)


def summed_rows(blocks: Blocks, size: int, part: Callable[[Iterator[pa.RecordBatch], np.ndarray], None]) -> np.ndarray:
    """One vector of sums over all rows, training or test."""
    return summed_cells(blocks.table.select("x", "target_class_id", "mask_train", "mask_test"), size, 1, lambda batches, totals: part(batches, totals[0]))[0]


def fit_logistic_cells(blocks: Blocks, statistics: dict[str, dict], cells: list[Cell], tolerance: float = 1e-9, most: int = 60) -> list[Model]:
    """Multinomial logistic models of all cells, to their minimum. A step that doesn't lower its cell's loss is halved."""
    for c in cells:
        if c.block not in statistics or not statistics[c.block]["classes"].all():
            raise ValueError(f"block {c.block} lacks a class to train on")
    wide, k = len(blocks.names) + 1, len(CLASSES)
    q = wide * k
    weights, steps, least = [np.zeros((k, wide)) for _ in cells], [None] * len(cells), [np.inf] * len(cells)
    free = np.tile(np.append(np.ones(wide - 1), 0.0), k)  # constants aren't penalized
    active = list(range(len(cells)))
    for _ in range(most):
        given = []
        for i in active:
            s = statistics[cells[i].block]
            given.append((blocks.trains.index(cells[i].block), cells[i].value * (s["n"] / (k * s["classes"]) if cells[i].balanced else np.ones(k)), weights[i], s["prepare"]))

        def add(totals: list[np.ndarray], x: np.ndarray, y: np.ndarray, r: np.ndarray, mask: np.ndarray, given: list = given) -> None:
            block, mine = None, None
            for total, (bit, w, theta, prepare) in sorted(zip(totals, given, strict=True), key=lambda t: t[1][0]):
                if block != bit:
                    block, mine = bit, (mask >> bit & 1).astype(bool)
                    inside, target = scaled(x[mine], prepare), y[mine].astype(int)
                if not len(inside):
                    continue
                p, share = softmax(inside @ theta.T), w[target]
                total[0] -= share @ np.log(np.maximum(p[np.arange(len(p)), target], 1e-300))
                miss = p.copy()
                miss[np.arange(len(p)), target] -= 1
                total[1 : 1 + q] += ((share[:, None] * miss).T @ inside).ravel()
                bend = total[1 + q :].reshape(k, wide, k, wide)
                for a in range(k):
                    for b in range(k):
                        bend[a, :, b, :] += (inside * (share * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ inside

        found = summed(blocks, 1 + q + q * q, len(active), add)
        going = []
        for place, i in enumerate(active):
            sums, theta = found[place], weights[i]
            loss = sums[0] + 0.5 * float(((theta.ravel() * free) ** 2).sum())
            if loss > least[i] + 1e-12 * abs(least[i]):
                steps[i] = steps[i] / 2
                weights[i] = theta - steps[i]
                if np.abs(steps[i]).max() > tolerance:
                    going.append(i)
                continue
            least[i] = loss
            slope = sums[1 : 1 + q] + theta.ravel() * free
            steps[i] = -np.linalg.lstsq(sums[1 + q :].reshape(q, q) + np.diag(free), slope, rcond=None)[0].reshape(k, wide)
            if np.abs(steps[i]).max() > tolerance:
                weights[i] = theta + steps[i]
                going.append(i)
        active = going
        if not active:
            break
    else:
        raise ValueError(f"no minimum after {most} passes for {[cells[i] for i in active]}")
    return [Model(c, blocks.names, s["prepare"], weights[i], s["returns"], trained_to=s["until"]) for i, c in enumerate(cells) for s in [statistics[c.block]]]


def fit_ridge_cells(blocks: Blocks, statistics: dict[str, dict], cells: list[Cell]) -> list[Model]:
    """Ridge models of the arithmetic return, the constant unpenalized: the moments of each block, then one small system a cell."""
    wide = len(blocks.names) + 1
    used = list(dict.fromkeys(c.block for c in cells))
    given = [(blocks.trains.index(b), statistics[b]["prepare"]) for b in used]

    def add(totals: list[np.ndarray], x: np.ndarray, y: np.ndarray, r: np.ndarray, mask: np.ndarray) -> None:
        for total, (bit, prepare) in zip(totals, given, strict=True):
            mine = (mask >> bit & 1).astype(bool)
            both = np.column_stack([scaled(x[mine], prepare), r[mine]])
            total += (both.T @ both).ravel()

    found = summed(blocks, (wide + 1) ** 2, len(used), add)
    models = []
    for c in cells:
        s, moments = statistics[c.block], found[used.index(c.block)].reshape(wide + 1, wide + 1)
        n = moments[wide - 1, wide - 1]
        centre = moments[:, wide - 1] / n  # means of the scaled features, of the constant and of the return
        about = moments - n * np.outer(centre, centre)
        xx, xy, yy = about[: wide - 1, : wide - 1], about[: wide - 1, wide], about[wide, wide]
        slope = np.linalg.solve(xx + c.value * np.eye(wide - 1), xy)
        sigma = math.sqrt(max(yy - 2 * slope @ xy + slope @ xx @ slope, 0.0) / n)
        models.append(Model(c, blocks.names, s["prepare"], np.append(slope, centre[wide] - slope @ centre[: wide - 1])[None, :], s["returns"], max(sigma, 1e-6), s["until"]))
    return models


def fit_cells(blocks: Blocks, statistics: dict[str, dict], cells: list[Cell]) -> list[Model]:
    ridge = [c for c in cells if c.family == "ridge"]
    logistic = [c for c in cells if c.family != "ridge"]
    # the same numbers under two families are one fit
    alike = list({(c.block, c.value, c.balanced): c for c in logistic}.values())
    fitted = {(m.cell.block, m.cell.value, m.cell.balanced): m for m in (fit_logistic_cells(blocks, statistics, alike) if alike else [])}
    again = [Model(**fitted[c.block, c.value, c.balanced].__dict__ | {"cell": c}) for c in logistic]
    return again + (fit_ridge_cells(blocks, statistics, ridge) if ridge else [])


def score_cells(blocks: Blocks, models: list[Model]) -> DataFrame:
    """A row for each model and row of the block that tests it: model (its place in the list), keys, targets, probabilities and expected return."""
    keep = [*blocks.keys, *TARGETS]
    schema = blocks.table.select(F.lit(0).alias("model"), *keep, *[F.lit(0.0).alias(n) for n in (*[f"p_{c}" for c in CLASSES], "expected_return_bps")]).schema
    bits, columns, features = [blocks.trains.index(m.cell.block) for m in models], schema.names, len(blocks.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, mask = matrix(batch, features), numbers(batch, "mask_test")
            for place, (model, bit) in enumerate(zip(models, bits, strict=True)):
                mine = np.flatnonzero(mask >> bit & 1)
                if len(mine):
                    p, expected = model.predict(x[mine])
                    some = batch.take(pa.array(mine))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), place, dtype=np.int32)), *[some.column(c) for c in keep], *[pa.array(p[:, c]) for c in range(len(CLASSES))], pa.array(expected)], names=columns)

    rows = blocks.table.filter("mask_test != 0").select("x", "mask_test", *keep).mapInArrow(run, schema)
    return rows.withColumn("target_class", F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("target_class_id").cast("int") + 1))


def judged(rows: DataFrame, by: list[str]) -> DataFrame:
    """Classification metrics, calibration error and mean absolute error of the expected return, by group."""
    error = rows.groupBy(*by).agg(F.avg(F.abs(F.col("arithmetic_return_bps") - F.col("expected_return_bps"))).alias("return_mae_bps"))
    return metrics.classification_metrics(rows, by).join(metrics.calibration_errors(rows, by), by).join(error, by)


def choose(scores: DataFrame) -> DataFrame:
    """scores: a row a fold, family, candidate (value, balanced) and inner block, with macro_f1, log_loss and return_mae_bps. For each fold and
    family the candidate of best mean F1, then lower mean log loss; for ridge of lowest mean error; equals go to no class weights, to the
    value nearest to 1 in powers of ten, to the smaller."""
    mean = scores.groupBy("fold", "family", "value", "balanced").agg(F.avg("macro_f1").alias("inner_macro_f1"), F.avg("log_loss").alias("inner_log_loss"), F.avg("return_mae_bps").alias("inner_return_mae_bps"))
    ridge = F.col("family") == "ridge"
    first, second = F.when(ridge, F.col("inner_return_mae_bps")).otherwise(-F.col("inner_macro_f1")), F.when(ridge, 0.0).otherwise(F.col("inner_log_loss"))
    order = Window.partitionBy("fold", "family").orderBy(first, second, F.col("balanced").cast("int"), F.abs(F.log10("value")), "value")  # candidates, a handful
    return mean.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


@dataclass
class Nested:
    """What a nested selection leaves: candidates' inner scores, choices, the refitted models, their outer predictions with decisions, the report."""

    scores: DataFrame
    chosen: DataFrame
    models: list[Model]
    predictions: DataFrame
    report: DataFrame


def by_model(models: list[Model], value: Callable[[Model], object]) -> Column:
    return F.element_at(F.array(*[F.lit(value(m)) for m in models]), F.col("model") + 1)


def nested_selection(rows: DataFrame, folds: list[Fold], names: list[str] = FEATURES, gap_minutes: int = 181, candidates: dict[str, tuple[float, ...]] = CANDIDATES, balanced: tuple[bool, ...] = (True,),
                     costs: backtest.Costs = backtest.Costs(), stress: backtest.Costs = backtest.Costs(spread_bps=4.5), policies: tuple[backtest.Policy, ...] = backtest.POLICIES, minimum_trades: int = 20, allowed: list[str] = FEATURES) -> Nested:
    """For each fold and family: candidates fitted on the inner training blocks, the choice by their inner validations, a policy by trades
    on these, the choice refitted on the outer training block, and a row of thirteen metrics on the outer test. Nothing of an outer test is
    seen before; the calibration block isn't read. Decisions under stress are those of the base costs.

    What comes to the driver is a row a cell or block; rows are written twice (blocks, outer decisions), both narrow.
    """
    blocks = marked_blocks(rows, folds, names, gap_minutes, allowed=allowed)
    statistics = block_statistics(blocks)
    if gone := [b for b in blocks.trains if b not in statistics]:
        raise ValueError(f"no rows to train on: {', '.join(gone)}")
    inner = blocks.inner()
    grid = [Cell(b, family, v, w) for b in inner for family, values in candidates.items() for v in values for w in ((True,) if family != "logistic" else balanced)]
    tried = fit_cells(blocks, statistics, grid)
    named = {"fold": lambda m: inner[m.cell.block], "block": lambda m: m.cell.block, "family": lambda m: m.cell.family, "value": lambda m: m.cell.value, "balanced": lambda m: m.cell.balanced}
    said = written(score_cells(blocks, tried).withColumns({k: by_model(tried, f) for k, f in named.items()}))
    scores = judged(said, list(named))
    if len({(m.cell.block) for m in tried}) * len({(m.cell.family, m.cell.value, m.cell.balanced) for m in tried}) != (scores := written(scores)).count():
        raise ValueError("an inner validation has no rows")
    chosen = written(choose(scores))
    picked = {(r.fold, r.family): r for r in chosen.collect()}
    train = {f.name: f.train.name for f in folds}
    models = fit_cells(blocks, statistics, [Cell(train[fold], family, r.value, r.balanced) for (fold, family), r in sorted(picked.items())])
    fold_of = {f.train.name: f.name for f in folds}

    policy = trial(said.join(F.broadcast(chosen.select("fold", "family", "value", "balanced")), ["fold", "family", "value", "balanced"], "left_semi"), costs, policies, minimum_trades, {f.name: len(f.inner) for f in folds})
    limits = {key: policies[policy[key]] if key in policy else CASH for key in picked}
    outer = score_cells(blocks, models).withColumns({"fold": by_model(models, lambda m: fold_of[m.cell.block]), "family": by_model(models, lambda m: m.cell.family)})
    limit = lambda f: by_model(models, lambda m: f(limits[fold_of[m.cell.block], m.cell.family]))
    asked = backtest.Policy(limit(lambda p: p.min_confidence), limit(lambda p: p.min_edge_bps))
    decisions = written(apart(backtest.with_decisions(outer, costs, asked), ["fold", "family"]))
    by = ["fold", "family"]
    base, strained = backtest.with_pnl(decisions, costs), backtest.with_pnl(decisions, stress)
    done = base.filter("decision_status = 'executed'").groupBy(*by).agg(F.count("*").alias("trades"), F.sum("net_return_bps").alias("net_bps"), (2 * F.count("*")).alias("turnover"))
    worse = strained.filter("decision_status = 'executed'").groupBy(*by).agg(F.sum("net_return_bps").alias("stress_net_bps"))
    held = backtest.exposure(decisions, by).select(*by, F.col("exposure").alias("exposure_fraction"))
    report = judged(decisions, by).join(done, by, "left").join(worse, by, "left").join(backtest.max_drawdown(base, by).withColumnRenamed("max_drawdown_bps", "drawdown_bps"), by, "left").join(held, by, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast(t)) for c, t in (("trades", "long"), ("turnover", "long"), ("net_bps", "double"), ("stress_net_bps", "double"), ("drawdown_bps", "double"))}
    place = F.coalesce(*[F.when((F.col("fold") == f) & (F.col("family") == g), F.lit(k)) for (f, g), k in policy.items()], F.lit(-1))
    return Nested(scores, chosen, models, base, report.withColumns(zero).join(chosen, by).withColumn("policy", place))


def apart(decisions: DataFrame, by: list[str]) -> DataFrame:
    """Trades that never overlap, decided for each group and instrument on its own."""
    own = decisions.withColumn("_own", F.col("instrument")).withColumn("instrument", F.concat_ws("#", "instrument", *by))
    return backtest.without_overlap(own).withColumn("instrument", F.col("_own")).drop("_own")


def trial(said: DataFrame, costs: backtest.Costs, policies: tuple[backtest.Policy, ...], minimum_trades: int, needed: dict[str, int]) -> dict[tuple[str, str], int]:
    """For each fold and family the policy of best mean net over the inner validations, if it has the trades in each of them and gains; none: cash."""
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("policy"), F.lit(float(p.min_confidence)).alias("_c"), F.lit(float(p.min_edge_bps)).alias("_e")) for k, p in enumerate(policies)]))
    decided = backtest.with_decisions(said.select("*", each), costs, backtest.Policy(F.col("_c"), F.col("_e")))
    done = backtest.with_pnl(apart(decided, ["fold", "family", "block", "policy"]), costs).filter("decision_status = 'executed'")
    per = done.groupBy("fold", "family", "policy", "block").agg(F.count("*").alias("n_trades"), F.sum("net_return_bps").alias("net_bps"))
    whole = per.groupBy("fold", "family", "policy").agg(F.count("*").alias("n_blocks"), F.min("n_trades").alias("least"), F.avg("net_bps").alias("mean"))
    blocks = F.element_at(F.create_map(*[F.lit(x) for pair in needed.items() for x in pair]), F.col("fold"))
    good = whole.filter((F.col("n_blocks") == blocks) & (F.col("least") >= minimum_trades) & (F.col("mean") > 0))
    return {(r.fold, r.family): r.policy for r in good.groupBy("fold", "family").agg(F.max_by("policy", F.struct("mean", -F.col("policy"))).alias("policy")).collect()}


# What a summary says of each family, and whether more is better; and the tests that a family has to pass to be promoted: metric,
# statistic, and whether it has to be over, at least, or at most the baseline's, or a number.
METRICS = {
    "accuracy": True, "balanced_accuracy": True, "macro_f1": True, "brier": False, "log_loss": False, "return_mae_bps": False, "calibration_error": False,
    "net_bps": True, "stress_net_bps": True, "trades": True, "drawdown_bps": False, "turnover": False, "exposure_fraction": False,
}
GATES = [
    ("macro_f1", "mean", "over", None), ("macro_f1", "worst", "at least", None), ("brier", "mean", "at most", None),
    ("trades", "worst", "at least", 20.0), ("net_bps", "worst", "over", 0.0), ("net_bps", "worst", "at least", None), ("stress_net_bps", "mean", "over", 0.0),
]


def promotion(summary: DataFrame, baseline: str = "reference", gates: list[tuple] = GATES) -> DataFrame:
    """summary: family, metric, mean, worst (horizon_summary). For each family but the baseline: the tests it passes, those it fails, and
    promoted, if there are none; a value that isn't there passes nothing."""
    spark = summary.sparkSession
    table = F.broadcast(spark.createDataFrame([(k, *g) for k, g in enumerate(gates)], "gate int, metric string, statistic string, rule string, bound double"))
    value = F.when(F.col("statistic") == "mean", F.col("mean")).otherwise(F.col("worst"))
    met = summary.join(table, "metric").withColumn("value", value)
    against = met.filter(F.col("family") == baseline).select("gate", F.col("value").alias("_base"))
    bound = F.coalesce("bound", "_base")
    passed = F.when(F.col("rule") == "over", F.col("value") > bound).when(F.col("rule") == "at least", F.col("value") >= bound).otherwise(F.col("value") <= bound)
    both = met.filter(F.col("family") != baseline).join(F.broadcast(against), "gate").withColumn("_ok", F.coalesce(passed, F.lit(False)))
    failed = F.array_sort(F.collect_list(F.when(~F.col("_ok"), F.concat_ws(" ", "metric", "statistic", "rule", F.coalesce(F.col("bound").cast("string"), F.lit(baseline))))))  # as many as there are gates
    return both.groupBy("family").agg(F.count_if("_ok").alias("n_passed"), F.array_join(failed, "; ").alias("failed"), F.bool_and("_ok").alias("promoted"))
