"""Models kept under a manifest that is their content, reloaded only if nothing has changed and they fit the data; runs recorded and done again."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.bars import CLASSES
from tickloom.operators import walkforward
from tickloom.operators.splits import Fold
from tickloom.operators.walkforward import Blocks, Cell, Model, Nested
from tickloom.sources.inventory import CONTENT, InventoryError, seal, unsealed
from tickloom.sources.tables import content_version, read_text, write_text

TIME = "%Y-%m-%d %H:%M:%S"
PREDICTED = [*[f"p_{c}" for c in CLASSES], "expected_return_bps"]


def save_bundle(spark: SparkSession, root: str, models: list[Model] | PipelineModel, names: list[str], data_version: str, trained_to: str, settings: dict[str, Any] | None = None) -> str:
    """A new folder under root, named by the models' description, with the models and a manifest; the path. Models are cells as JSON, or a fitted pipeline."""
    body = {"names": list(names), "classes": list(CLASSES), "data_version": data_version, "trained_to": trained_to, "settings": settings or {}, "kind": "pipeline" if isinstance(models, PipelineModel) else "cells"}
    if isinstance(models, PipelineModel):
        body["uid"] = models.uid
    else:
        body["cells"] = [m.cell.__dict__ for m in models]
        body["models"] = content_version([m.to_json() for m in models])
    path = f"{root.rstrip('/')}/{content_version(body).removeprefix('sha256:')[:16]}"
    if isinstance(models, PipelineModel):
        models.write().save(f"{path}/{CONTENT}/pipeline")
    else:
        spark.createDataFrame([(k, m.to_json()) for k, m in enumerate(models)], "place int, model string").coalesce(1).write.parquet(f"{path}/{CONTENT}/models")
    seal(spark, path, body)
    write_text(spark, f"{root.rstrip('/')}/latest.txt", path.rsplit("/", 1)[1])
    return path


def load_bundle(spark: SparkSession, path: str, names: list[str], data_version: str, as_of: str, max_age_days: int) -> list[Model] | PipelineModel:
    """The models of a bundle, if its files and manifest are as they were written, its features are these in this order, it was trained on this
    version of the data, and on nothing older than max_age_days before as_of nor on anything after it; else an InventoryError."""
    body = unsealed(spark, path)["body"]
    if body["names"] != list(names) or body["classes"] != list(CLASSES):
        raise InventoryError(f"{path}: made for other features or classes")
    if body["data_version"] != data_version:
        raise InventoryError(f"{path}: trained on {body['data_version']}, not on {data_version}")
    age = datetime.strptime(as_of, TIME) - datetime.strptime(body["trained_to"], TIME)
    if age > timedelta(days=max_age_days):
        raise InventoryError(f"{path}: {age.days} days old, over {max_age_days}")
    if age < timedelta(0):
        raise InventoryError(f"{path}: trained on what comes after {as_of}")
    if body["kind"] == "pipeline":
        return PipelineModel.load(f"{path}/{CONTENT}/pipeline")
    models = [Model.from_json(r.model) for r in spark.read.parquet(f"{path}/{CONTENT}/models").orderBy("place").collect()]  # as many as cells were chosen
    if content_version([m.to_json() for m in models]) != body["models"]:
        raise InventoryError(f"{path}: the models aren't those described")
    return models


def described(folds: list[Fold]) -> list[dict]:
    """Folds with fixed bounds as plain values."""
    block = lambda b: [b.name, b.start.strftime(TIME), b.end.strftime(TIME)]
    return [{"name": f.name, "train": block(f.train), "calibration": block(f.calibration), "test": block(f.test), "inner": [[block(a), block(b)] for a, b in f.inner]} for f in folds]


def record_run(spark: SparkSession, path: str, rows: DataFrame, nested: Nested, folds: list[Fold], names: list[str], gap_minutes: int) -> dict[str, Any]:
    """Keep what a nested selection was made of and came to: the rows with their blocks, the inner scores, the choices, the models and the outer
    predictions, under a manifest with the folds and settings. Folds need fixed bounds. Returns the manifest."""
    blocks = walkforward.marked_blocks(rows, folds, names, gap_minutes, allowed=names)
    blocks.table.write.parquet(f"{path}/{CONTENT}/rows")
    nested.scores.write.parquet(f"{path}/{CONTENT}/scores")
    nested.chosen.write.parquet(f"{path}/{CONTENT}/chosen")
    nested.predictions.select("sample_id", "fold", "family", *PREDICTED).write.parquet(f"{path}/{CONTENT}/predictions")
    spark.createDataFrame([(k, m.to_json()) for k, m in enumerate(nested.models)], "place int, model string").coalesce(1).write.parquet(f"{path}/{CONTENT}/models")
    return seal(spark, path, {"folds": described(folds), "names": names, "gap_minutes": gap_minutes, "places": spark.sparkContext.defaultParallelism, "spark": spark.version})


def differences(saved: DataFrame, again: DataFrame, keys: list[str], values: list[str], tolerance: float) -> DataFrame:
    """One row: rows of both, rows that only one has (as a multiset, all columns), keys that only one has, and the largest difference of a value
    and how many rows differ by more than the tolerance."""
    columns = [*keys, *values]
    a, b = saved.select(columns), again.select(columns)
    marked = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(-1)))
    exact = marked.groupBy(*columns).agg(F.sum("_side").alias("n")).agg(F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).alias("n_only_saved"), F.coalesce(F.sum(F.greatest(-F.col("n"), F.lit(0))), F.lit(0)).alias("n_only_again"))
    side = lambda c, s: F.max(F.when(F.col("_side") == s, F.col(c)))
    per = marked.groupBy(*keys).agg(F.sum("_side").alias("n"), F.count_if(F.col("_side") == 1).alias("n_saved"), F.greatest(*[F.abs(side(v, 1) - side(v, -1)) for v in values], F.lit(0.0)).alias("off"))
    near = per.agg(F.coalesce(F.sum("n_saved"), F.lit(0)).alias("n_rows"), F.count_if(F.col("n") != 0).alias("n_other_keys"), F.coalesce(F.max("off"), F.lit(0.0)).alias("largest"), F.count_if(F.col("off") > tolerance).alias("n_far"))
    return near.join(exact)


def reproduce_run(spark: SparkSession, path: str, folds: list[Fold], tolerance: float = 1e-9) -> DataFrame:
    """Do a recorded run's last steps again and hold them against it, as one row: choices that the saved scores don't give, models whose weights differ
    by more than the tolerance, and differences() of the outer predictions. Every file is checked before; the folds have to be the recorded ones.

    The sums that models are fitted from are added in the order of partitions, so on the same rows and number of places the refit is
    the same to the last bit; elsewhere sums are rounded in another order, which the tolerance is for.
    """
    body = unsealed(spark, path)["body"]
    if described(folds) != body["folds"]:
        raise InventoryError(f"{path}: recorded with other folds")
    read = lambda name: spark.read.parquet(f"{path}/{CONTENT}/{name}")
    chosen, saved = read("chosen"), [Model.from_json(r.model) for r in read("models").orderBy("place").collect()]
    pick = ["fold", "family", "value", "balanced"]
    other = walkforward.choose(read("scores")).select(pick).exceptAll(chosen.select(pick)).count()
    blocks = Blocks(read("rows"), body["names"], walkforward.KEYS, [b for f in folds for b in (f.train.name, *[t.name for t, _ in f.inner])], folds)
    train = {f.name: f.train.name for f in folds}
    again = walkforward.fit_cells(blocks, walkforward.block_statistics(blocks), [Cell(train[r.fold], r.family, r.value, r.balanced) for r in sorted(chosen.select(pick).collect())])
    by_cell = {m.cell: m for m in again}
    moved = sum(m.cell not in by_cell or abs(m.weights - by_cell[m.cell].weights).max() > tolerance for m in saved)
    fold_of = {v: k for k, v in train.items()}
    scored = walkforward.score_cells(blocks, again).withColumns({"fold": walkforward.by_model(again, lambda m: fold_of[m.cell.block]), "family": walkforward.by_model(again, lambda m: m.cell.family)})
    return differences(read("predictions"), scored, ["sample_id", "fold", "family"], PREDICTED, tolerance).select(F.lit(other).alias("n_other_choices"), F.lit(moved).alias("n_other_models"), "*")


def reevaluate(models: list[Model], rows: DataFrame, universe: DataFrame, keys: list[str] = walkforward.KEYS) -> DataFrame:
    """Predictions of loaded models on the rows of a restricted universe (sample_id): model (its place), keys, targets, probabilities, expected return."""
    names = models[0].names
    kept = rows.join(universe.select("sample_id").distinct(), "sample_id", "left_semi")
    table = kept.select(F.array(*[F.col(n).cast("double") for n in names]).alias("x"), *walkforward.TARGETS, *keys, F.lit(0).cast("long").alias("mask_train"), F.lit((1 << len(models)) - 1).cast("long").alias("mask_test"))
    blocks = Blocks(table, names, keys, [str(k) for k in range(len(models))], [])
    return walkforward.score_cells(blocks, [Model(**m.__dict__ | {"cell": Cell(str(k), m.cell.family, m.cell.value, m.cell.balanced)}) for k, m in enumerate(models)])


def latest(spark: SparkSession, root: str) -> str:
    """The path of the bundle saved last."""
    return f"{root.rstrip('/')}/{read_text(spark, f'{root}/latest.txt').strip()}"
