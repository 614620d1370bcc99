"""Train-only estimators with Spark ML, scored into probability columns. Parity with other libraries' optimizers is not
claimed; objectives and regularization are matched where Spark has them."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.bars import CLASSES, class_probabilities
from tickloom.operators.contracts import require_allowed
from tickloom.operators.features import FEATURES
from tickloom.operators.splits import class_weights, impute_scale_stats, standardized

def require_disjoint(train: DataFrame, validation: DataFrame, key: str = "sample_id") -> None:
    if train.select(key).intersect(validation.select(key)).limit(1).count():
        raise ValueError("train and validation share samples")


def fit_logistic(train: DataFrame, names: list[str], c: float = 0.1, balanced: bool = True, target: str = "target_class_id", allowed: list[str] = FEATURES):
    """Multinomial logistic regression; c as in C * sum of losses + half the squared weights."""
    require_allowed(names, allowed)
    rows = train.withColumn("label", F.col(target).cast("double"))
    n = rows.count()
    if balanced:
        rows = rows.join(F.broadcast(class_weights(rows, "label").select("label", "weight")), "label")
    lr = LogisticRegression(family="multinomial", regParam=1 / (c * max(1, n)), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8, **({"weightCol": "weight"} if balanced else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), lr]).fit(rows)


def score_classes(model, rows: DataFrame) -> DataFrame:
    p = vector_to_array("probability")
    out = model.transform(rows).withColumns({f"p_{c}": p[i] for i, c in enumerate(CLASSES)})
    return out.drop("features", "rawPrediction", "probability", "prediction", "label")


def fit_ridge(train: DataFrame, names: list[str], alpha: float = 10.0, target: str = "arithmetic_return_bps", allowed: list[str] = FEATURES):
    """Ridge with the closed form's penalty: Spark scales the label, so its deviation enters. Returns the model and the
    residuals' deviation."""
    require_allowed(names, allowed)
    n, spread = train.agg(F.count("*"), F.stddev_pop(target)).first()
    lr = LinearRegression(labelCol=target, regParam=alpha * (spread or 1.0) / max(1, n), elasticNetParam=0.0, standardization=False, solver="normal")
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), lr]).fit(train)
    e = model.transform(train).agg(F.stddev_pop(F.col(target) - F.col("prediction"))).first()[0]
    return model, max(e or 0.0, 1e-9)


def score_ridge(model, sigma: float, rows: DataFrame, threshold_bps: float = 6.0) -> DataFrame:
    out = model.transform(rows).withColumnRenamed("prediction", "expected_return_bps").drop("features")
    return out.withColumns(class_probabilities(F.col("expected_return_bps"), sigma, threshold_bps))


def fit_trees(train: DataFrame, names: list[str], depth: int = 3, rounds: int = 20, target: str = "target_class_id", allowed: list[str] = FEATURES):
    """Spark's boosted trees, binary, one against the rest; operators.boosting has three-class ones."""
    require_allowed(names, allowed)
    rows = train.withColumn("label", F.col(target).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), OneVsRest(classifier=GBTClassifier(maxDepth=depth, maxIter=rounds, stepSize=0.05, seed=42))]).fit(rows)


def prepare(train: DataFrame, rows: DataFrame, names: list[str]) -> DataFrame:
    """rows imputed and scaled by the training rows' statistics alone."""
    return standardized(rows, impute_scale_stats(train, names), names)
