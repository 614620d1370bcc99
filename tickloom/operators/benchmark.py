"""Comparisons of model families over folds: priors, coverage, summaries, gates and choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.bars import BPS, CLASSES
from tickloom.operators.paths import PARTS, STEPS
from tickloom.operators.splits import Block
from tickloom.schema import SERIES, later

QUANTILES = ["q10", "q50", "q90"]


def class_priors(train: DataFrame) -> DataFrame:
    """A row for each class, seen or not: n, its share, and its mean return, 0 if unseen."""
    y = F.col("target_class")
    sums = train.agg(F.count("*").alias("all"), *[x for c in CLASSES for x in (F.count_if(y == c).alias(f"n_{c}"), F.avg(F.when(y == c, F.col("arithmetic_return_bps"))).alias(f"mean_{c}"))])
    one = lambda c: F.struct(F.lit(c).alias("target_class"), F.col(f"n_{c}").alias("n"), F.coalesce(F.try_divide(F.col(f"n_{c}"), F.col("all")), F.lit(0.0)).alias("prior"), F.coalesce(f"mean_{c}", F.lit(0.0)).alias("mean_return_bps"))
    return sums.select(F.inline(F.array(*[one(c) for c in CLASSES])))


def prior_predictions(train: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with the training part's class shares as probabilities and the return that they expect."""
    p = class_priors(train)
    wide = p.agg(*[F.max(F.when(F.col("target_class") == c, F.col("prior"))).alias(f"p_{c}") for c in CLASSES], F.sum(F.col("prior") * F.col("mean_return_bps")).alias("expected_return_bps"))
    return rows.drop(*wide.columns).join(F.broadcast(wide))


def fold_coverage(rows: DataFrame, blocks: list[Block], names: list[str], gap_minutes: int = 181) -> DataFrame:
    """For every block, empty ones too: its rows, and how many of the named features it never observes. Blocks whose name ends in
    train are purged of what reaches past their end, others are whole."""
    inside = {b.name: F.coalesce(b.predicate(gap_minutes, b.name.endswith("train")), F.lit(False)) for b in blocks}
    sums = rows.agg(*[x for i, p in enumerate(inside.values()) for x in (F.count_if(p).alias(f"n{i}"), *[F.count_if(p & F.col(n).isNotNull()).alias(f"n{i}_{n}") for n in names])])
    unseen = lambda i: sum([(F.col(f"n{i}_{n}") == 0).cast("int") for n in names], F.lit(0))
    return sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("block"), F.col(f"n{i}").alias("n_rows"), unseen(i).alias("n_unsupported")) for i, k in enumerate(inside)])))


def label_coverage(candidates: DataFrame, labelled: DataFrame) -> DataFrame:
    """By series: candidates, those that got a label, and those that didn't."""
    both = candidates.select(*SERIES, F.lit(1).alias("c"), F.lit(0).alias("l")).unionByName(labelled.select(*SERIES, F.lit(0).alias("c"), F.lit(1).alias("l")))
    return both.groupBy(*SERIES).agg(F.sum("c").alias("n_candidates"), F.sum("l").alias("n_eligible")).withColumn("n_dropped", F.col("n_candidates") - F.col("n_eligible"))


def path_dataset(labelled: DataFrame, paths: DataFrame, minutes: int = 15, latency: int = 1) -> DataFrame:
    """Labels joined with the paths from the same prediction, and in_time: whether the path ends `minutes` after it, entry is one latency
    after it and the label ends `minutes` after entry."""
    both = labelled.join(paths, [*SERIES, "prediction_time_utc"])
    t = F.col("prediction_time_utc")
    ok = (F.col("path_end_utc") == later(t, minutes)) & (F.col("entry_time_utc") == later(t, latency)) & (F.col("label_end_time_utc") == later(t, minutes + latency))
    return both.withColumn("in_time", F.coalesce(ok, F.lit(False)))


def whole_path_parts(paths: DataFrame) -> DataFrame:
    """The whole path as one bar in log bps: agg_gap, agg_body, agg_upper, agg_lower."""
    log = lambda a, b: BPS * (F.log(a) - F.log(b))
    top, bottom = F.greatest("agg_open", "agg_close"), F.least("agg_open", "agg_close")
    return paths.withColumns({"agg_gap": log("agg_open", "anchor_close"), "agg_body": log("agg_close", "agg_open"), "agg_upper": F.greatest(log("agg_high", top), F.lit(0.0)), "agg_lower": F.greatest(log(bottom, "agg_low"), F.lit(0.0))})


def quantile_columns(rows: DataFrame, keys: list[str], path: str = "path_quantiles", whole: str = "whole_quantiles", steps: int = STEPS) -> DataFrame:
    """Nested quantiles as named columns: path is an array of steps of parts of quantiles, whole one of parts of quantiles."""
    named = [F.col(path)[k][p][q].alias(f"step_{k + 1}_{part}_{name}") for k in range(steps) for p, part in enumerate(PARTS) for q, name in enumerate(QUANTILES)]
    return rows.select(*keys, *named, *[F.col(whole)[p][q].alias(f"aggregate_{part}_{name}") for p, part in enumerate(PARTS) for q, name in enumerate(QUANTILES)])


def horizon_summary(folds: DataFrame, metrics: dict[str, bool], by: str = "family") -> DataFrame:
    """folds: a row a family and fold with the metrics as columns. A row a family and metric: mean, median, worst (lowest where
    higher is better, else highest) and the number of folds; worst and mean are null where a fold has no value."""
    long = folds.select(by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(up).alias("up"), F.col(m).cast("double").alias("v")) for m, up in metrics.items()])))
    g = long.groupBy(by, "metric", "up").agg(F.count("*").alias("n_folds"), F.count("v").alias("n"), F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"), F.min("v").alias("low"), F.max("v").alias("high"))
    whole = lambda c: F.when(F.col("n") == F.col("n_folds"), c)
    return g.select(by, "metric", "n_folds", whole(F.col("mean")).alias("mean"), whole(F.col("median")).alias("median"), whole(F.when(F.col("up"), F.col("low")).otherwise(F.col("high"))).alias("worst"))


def admitted(summary: DataFrame, baseline: str, by: str = "family") -> DataFrame:
    """Families with a better mean F1 than the baseline's, no worse worst F1 and no higher mean Brier score, best first: place 1 is the
    research champion. No row where none is; the baseline then stays."""
    wide = summary.filter(F.col("metric").isin("macro_f1", "brier")).groupBy(by).pivot("metric", ["macro_f1", "brier"]).agg(F.first("mean").alias("mean"), F.first("worst").alias("worst"))
    base = wide.filter(F.col(by) == baseline).select(*[F.col(c).alias(f"b_{c}") for c in wide.columns if c != by])
    better = (F.col("macro_f1_mean") > F.col("b_macro_f1_mean")) & (F.col("macro_f1_worst") >= F.col("b_macro_f1_worst")) & (F.col("brier_mean") <= F.col("b_brier_mean"))
    order = Window.orderBy(F.col("macro_f1_mean").desc(), "brier_mean", by)  # over families, a handful
    return wide.filter(F.col(by) != baseline).join(F.broadcast(base)).filter(better).select(by, "macro_f1_mean", "brier_mean", F.row_number().over(order).alias("place"))


def selected_candidate(scores: DataFrame) -> DataFrame:
    """scores: c, weighted, macro_f1, log_loss. The best F1, then the lower log loss, no class weights first, C nearest to 1 in powers
    of ten, the smaller C."""
    return scores.orderBy(F.col("macro_f1").desc(), "log_loss", F.col("weighted").cast("int"), F.abs(F.log10("c")), "c").limit(1)


def head_and_tail(rows: DataFrame, n: int, by: list[str], order: str) -> DataFrame:
    """The first and the last n rows of each group, each row once."""
    first, last = (Window.partitionBy(*by).orderBy(o) for o in (F.col(order), F.col(order).desc()))
    head = rows.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= n)
    tail = rows.withColumn("_k", F.row_number().over(last)).filter(F.col("_k") <= n)
    return head.drop("_k").unionByName(tail.drop("_k")).distinct()


def availability(rows: DataFrame, names: list[str]) -> DataFrame:
    """For each feature the rows that have it, and their share."""
    sums = rows.agg(F.count("*").alias("all"), *[F.count(n).alias(n) for n in names])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("n_there"), F.try_divide(F.col(n), F.col("all")).alias("share")) for n in names])))


def variants(mvp: list[str], price: list[str], session: list[str], regime: list[str], higher: list[str]) -> dict[str, list[str]]:
    """The five sets of features of the ablation, each the one before and one more group; names and order are fixed values."""
    named = [("mvp", mvp), ("price_3min", price), ("price_session_3min", session), ("price_session_regime_3min", regime), ("price_session_regime_multitimeframe", higher)]
    out, so_far = {}, []
    for name, more in named:
        out[name] = so_far = [*so_far, *more]
    return out


def variant_support(rows: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """For each set the number of features and of rows that have them all, in one pass."""
    whole = {k: F.array_position(F.array(*[F.col(n).isNull() for n in names]), True) == 0 for k, names in sets.items()}
    sums = rows.agg(*[F.count_if(c).alias(k) for k, c in whole.items()])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("variant"), F.lit(len(v)).alias("n_features"), F.col(k).alias("n_whole")) for k, v in sets.items()])))


def part_normalizer(paths: DataFrame, steps: int = STEPS) -> DataFrame:
    """part, mean, scale of each path part over all steps of the given (training) rows; a scale of 0 counts as 1."""
    long = paths.select(F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"path_{k}_{p}").alias("v")) for k in range(1, steps + 1) for p in PARTS])))
    g = long.groupBy("part").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("scale"))
    return g.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0))


def sequence_normalizer(found: DataFrame, channels: list[str]) -> DataFrame:
    """channel, median, mean, scale over all steps of the given (training) sequences; missing values become the median first."""
    steps = found.select(F.inline("sequence")).select(*channels)
    from tickloom.operators.splits import impute_scale_stats

    return impute_scale_stats(steps, channels).withColumnRenamed("feature", "channel")
