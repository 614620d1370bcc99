"""Metrics of probabilistic three-class predictions, from counts and sums that combine map-side."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.bars import CLASSES, likeliest
from tickloom.scratch import written

EPS = 2.220446049250313e-16


def stated() -> list[Column]:
    return [F.col(f"p_{c}") for c in CLASSES]


def predicted() -> Column:
    return likeliest(*stated())


def confidence() -> Column:
    return F.greatest(*stated())


def bad_probabilities() -> Column:
    """Not finite, out of [0, 1], or a row that doesn't sum to 1 within 1e-9."""
    down, neutral, up = stated()
    bad = F.abs(down + neutral + up - 1) > 1e-9
    for p in (down, neutral, up):
        bad = bad | F.isnan(p) | (p < 0) | (p > 1)
    return F.coalesce(bad, F.lit(True))


def confusion(rows: DataFrame, true: str = "target_class") -> DataFrame:
    """Counts of all nine pairs, zeros too."""
    cells = [(t, p) for t in CLASSES for p in CLASSES]
    wide = rows.select(F.col(true).alias("t"), predicted().alias("p")).agg(*[F.count_if((F.col("t") == t) & (F.col("p") == p)).alias(f"{t}_{p}") for t, p in cells])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(t).alias("true_class"), F.lit(p).alias("predicted_class"), F.col(f"{t}_{p}").alias("n")) for t, p in cells])))


def classification_metrics(rows: DataFrame, by: list[Column | str] = (), true: str = "target_class") -> DataFrame:
    """n, accuracy, balanced accuracy (over classes that are there), macro F1 (over all three, 0 where undefined), log loss
    (clipped at double precision) and Brier score (0 to 2), by group."""
    y, p = F.col("_y"), F.col("_p")
    down, neutral, up = stated()
    prob = F.when(y == "down", down).when(y == "neutral", neutral).otherwise(up)
    brier = sum([(q - (y == c).cast("double")) * (q - (y == c).cast("double")) for q, c in zip(stated(), CLASSES, strict=True)], F.lit(0.0))
    marked = rows.withColumns({"_y": F.col(true), "_p": predicted()})
    sums = [F.count("*").alias("n"), F.avg((y == p).cast("double")).alias("accuracy"), F.avg(-F.log(F.least(F.greatest(prob, F.lit(EPS)), F.lit(1 - EPS)))).alias("log_loss"), F.avg(brier).alias("brier")]
    sums += [x for c in CLASSES for x in (F.count_if((y == c) & (p == c)).alias(f"_hit_{c}"), F.count_if(y == c).alias(f"_true_{c}"), F.count_if(p == c).alias(f"_said_{c}"))]
    g = marked.groupBy(*by).agg(*sums)
    recall = [F.try_divide(F.col(f"_hit_{c}"), F.col(f"_true_{c}")) for c in CLASSES]
    present = sum([(F.col(f"_true_{c}") > 0).cast("int") for c in CLASSES], F.lit(0))
    f1 = [F.coalesce(F.try_divide(2.0 * F.col(f"_hit_{c}"), F.col(f"_true_{c}") + F.col(f"_said_{c}")), F.lit(0.0)) for c in CLASSES]
    balanced = sum([F.coalesce(r, F.lit(0.0)) for r in recall], F.lit(0.0)) / present
    return g.withColumns({"balanced_accuracy": balanced, "macro_f1": sum(f1, F.lit(0.0)) / 3}).drop(*[f"_{k}_{c}" for c in CLASSES for k in ("hit", "true", "said")])


def metrics_by_hour(rows: DataFrame, true: str = "target_class") -> DataFrame:
    """All 24 UTC hours, n 0 and nulls where nothing happened."""
    found = classification_metrics(rows, [F.hour("prediction_time_utc").alias("utc_hour")], true)
    hours = rows.sparkSession.range(24).select(F.col("id").cast("int").alias("utc_hour"))
    return hours.join(found, "utc_hour", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def reliability(rows: DataFrame, buckets: int = 10, true: str = "target_class") -> DataFrame:
    """All confidence buckets with accuracy, mean confidence and their gap."""
    conf = confidence()
    bucket = F.least(F.floor(conf * buckets), F.lit(buckets - 1)).cast("int")
    found = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg((predicted() == F.col(true)).cast("double")).alias("accuracy"), F.avg(conf).alias("confidence"))
    spine = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return spine.join(found, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("gap", F.col("accuracy") - F.col("confidence"))


def expected_calibration_error(rows: DataFrame, buckets: int = 10) -> DataFrame:
    return reliability(rows, buckets).agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"))


def calibration_errors(rows: DataFrame, by: list[str], buckets: int = 10, true: str = "target_class") -> DataFrame:
    """calibration_error by group: over confidence buckets, the gap of accuracy and mean confidence weighted by rows."""
    conf = confidence()
    bucket = F.least(F.floor(conf * buckets), F.lit(buckets - 1)).alias("_bucket")
    per = rows.groupBy(*by, bucket).agg(F.count("*").alias("n"), F.abs(F.avg((predicted() == F.col(true)).cast("double")) - F.avg(conf)).alias("gap"))
    return per.groupBy(*by).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("calibration_error"))


def return_errors(rows: DataFrame, predicted_return: Column, actual: Column) -> DataFrame:
    e = predicted_return - actual
    return rows.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def fold_summary(metrics: DataFrame, names: dict[str, bool], by: list[str]) -> DataFrame:
    """Mean, median and worst of each metric over folds; worst follows the direction (True: higher is better) and is null
    where a fold has no value."""
    aggs = []
    for n, higher in names.items():
        worst = F.min(n) if higher else F.max(n)
        aggs += [F.avg(n).alias(f"{n}_mean"), F.percentile(n, 0.5).alias(f"{n}_median"), F.when(F.count(n) == F.count("*"), worst).alias(f"{n}_worst")]
    return metrics.groupBy(*by).agg(*aggs)


def ensemble(predictions: DataFrame, key: str, probabilities: list[str], others: list[str]) -> DataFrame:
    """Mean over seeds, probabilities scaled to sum to 1."""
    mean = predictions.groupBy(key).agg(*[F.avg(c).alias(c) for c in [*probabilities, *others]], F.count("*").alias("n_members"))
    total = sum([F.col(c) for c in probabilities], F.lit(0.0))
    return mean.select(key, "n_members", *[(F.col(c) / total).alias(c) for c in probabilities], *others)


def ordered_digest(rows: DataFrame, order: str, value: str, by: list[str], fan: int = 256) -> DataFrame:
    """n and digest of the values of each group in order. A leaf is the SHA-256 of `fan` values, each followed by a line feed; `fan` digests
    in a row, each followed by a line feed, give the digest above them, until one is left. Equal orders are equal, any swap or change is told.

    Rows are put in order by range and numbered across partitions with a row a partition and group; no task holds more than a range
    or `fan` digests, however large a group is. Rows that are equal in order should be equal in value. Null values count as empty.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = rows.select(*by, F.col(order).alias("_o"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("_v"))
    placed = written(narrow.repartitionByRange(parts, *by, "_o", "_v").sortWithinPartitions(*by, "_o", "_v").withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_p", F.shiftright("_at", 33))
    starts = placed.groupBy(*by, "_p").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_p")]
    joined = placed.alias("a").join(starts.alias("b"), reduce(and_, keys))
    now = joined.select(*[F.col(f"a.{c}").alias(c) for c in by], (F.col("a._at") - F.col("b._first") + F.col("b._base")).alias("_k"), F.col("a._v").alias("_h"))
    counts = starts.groupBy(*by).agg(F.sum("_n").cast("long").alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    leaves = True
    while leaves or most > 1:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_h"))), lambda x: x["_h"])  # at most `fan`
        whole = F.sha2(F.concat(F.array_join("_l", "\n"), F.lit("\n")), 256)
        alone = F.lit(not leaves) & (F.col("_up") == 0) & (F.size("_l") == 1)  # the group's digest already
        now = now.groupBy(*by, F.expr(f"_k div {fan}").alias("_up")).agg(listed.alias("_l")).select(*by, F.col("_up").alias("_k"), F.when(alone, F.col("_l")[0]).otherwise(whole).alias("_h"))
        most, leaves = -(-most // fan), False
    one = now.groupBy(*by).agg(F.max_by("_h", "_k").alias("digest"))
    return counts.alias("a").join(one.alias("b"), reduce(and_, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by])).select(*[F.col(f"a.{c}").alias(c) for c in by], "n", "digest")


def gaussian_log_loss_floor() -> float:
    return -math.log(EPS)
