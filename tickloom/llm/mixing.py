"""Mixing sources to target weights: iterative proportional fitting of token weights under the bound that no document is taken
more than once, then calibrated Poisson sampling. DataFrame functions only."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import discard, materialize, packed, skew_join, unpacked

DIMENSIONS = ("source", "lang", "topic")
ONE_TASK_CELLS = 200_000  # so many cells, of some numbers each, are swept in one task; more stay spread out
SWEEPS = 6  # that a job makes
log = logging.getLogger(__name__)


def topic_of(text: Column) -> Column:
    """A coarse topic where the table has none: legal and code by marker words, else prose by length."""
    text = F.coalesce(text, F.lit(""))
    has = lambda *words: F.greatest(*[F.contains(text, F.lit(w)) for w in words])
    return F.when(has("icense", "opyright"), "legal").when(has("token =", "key =", "import ", "://"), "code").when(F.length(text) < 500, "short").when(F.length(text) < 5000, "prose").otherwise("long")


def level(name: str) -> Column:
    """A column's values as strings, null a level of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def shared_out(df: DataFrame, by: list[str], size: str, weight: Column, budget: Column, name: str) -> DataFrame:
    """df with name, the factor m by which all rows of a group must be multiplied so that min(size, m * weight) sums to the
    group's budget; where all of the group is less than the budget, every row is at its size.

    The sum is a concave function of m, the least of the lines with the k rows of largest weight / size at their sizes and
    the others at m * weight; so m is the largest of (budget - the k sizes) / the other weights.
    """
    order = Window.partitionBy(*by).orderBy(F.try_divide("_w", size).desc(), *[c for c in df.columns if c not in (size,)])
    after, before = order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    line = F.try_divide(budget - F.coalesce(F.sum(size).over(before), F.lit(0.0)), F.sum("_w").over(after))
    lined = df.withColumn("_w", weight).withColumn("_line", F.when(F.col("_w") > 0, line))
    return lined.withColumn(name, F.coalesce(F.max("_line").over(Window.partitionBy(*by)), F.lit(0.0))).drop("_w", "_line")


def level_targets(cells: DataFrame, dimension: str, shares: dict[str, float] | None, temper: float, fraction: float) -> DataFrame:
    """dimension and t_dimension, the tokens to take of each level: `fraction` of all tokens by the given shares, or by observed
    shares to the power `temper`. A level gives no more than it has; what is asked beyond goes to the others by their shares."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").alias("tokens"))
    if shares is None:
        share = F.pow(F.col("tokens"), F.lit(temper))
    else:
        given = [F.when(F.col(dimension) == ("null" if k is None else f"={k}"), F.lit(float(v))) for k, v in shares.items()]
        share = F.coalesce(*given, F.lit(0.0)) if given else F.lit(0.0)
    whole = Window.partitionBy("_all")
    asked = sums.withColumn("_all", F.lit(1)).withColumn("_share", F.when(F.col("tokens") > 0, share).otherwise(0.0)).withColumn("_budget", F.lit(fraction) * F.sum("tokens").over(whole))
    met = shared_out(asked, ["_all"], "tokens", F.col("_share"), F.col("_budget"), "_m")
    return met.select(dimension, F.least(F.col("tokens"), F.col("_m") * F.col("_share")).alias(f"t{dimension}"))


def sweep(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One round of proportional fitting: per dimension all weights of a level are multiplied so that its tokens meet its target."""
    for key in keys:
        cells = shared_out(cells, [key], "tokens", F.col("tokens") * F.col("w"), F.col(f"t{key}"), "_m").withColumn("w", F.col("w") * F.col("_m")).drop("_m")
    return cells


def rake(cells: DataFrame, keys: list[str], tolerance: float = 1e-4, jobs: int = 20) -> tuple[DataFrame, float]:
    """(cells with w, the largest miss): min(1, w) is each cell's inclusion probability.

    cells: keys, tokens and a target a key. Cells with a level of no target are out from the start. A job makes SWEEPS
    sweeps; it ends once no level of any dimension is off by more than `tolerance` of all tokens to take. Targets that
    contradict one another, or levels that share no cell, leave a miss: the caller is told how large.
    """
    some = reduce(lambda a, b: a & b, [F.col(f"t{k}") > 0 for k in keys]) & (F.col("tokens") > 0)
    now = cells.withColumn("w", F.when(some, 1.0).otherwise(0.0))
    together = cells.count() <= ONE_TASK_CELLS
    now = materialize(now)
    before = None
    for _ in range(jobs):
        fitted = now.coalesce(1) if together else now
        for _ in range(SWEEPS):
            fitted = sweep(fitted, keys)
        fitted, old = materialize(fitted), now
        discard(old)
        now, taken = fitted, F.col("tokens") * F.least(F.col("w"), F.lit(1.0))
        miss = 0.0
        for k in keys:
            off = fitted.groupBy(k).agg(F.sum(taken).alias("s"), F.max(f"t{k}").alias("t"))
            worst, total = off.agg(F.max(F.abs(F.col("s") - F.col("t"))), F.sum("t")).first()
            miss = max(miss, worst / total) if total else miss
        if miss <= tolerance or (before is not None and abs(before - miss) <= tolerance / 100):
            break
        before = miss
    return now, miss


def fitted_cells(docs: DataFrame, keys: list[str], targets: dict[str, dict[str | None, float]], temper: float, fraction: float, tolerance: float = 1e-4) -> tuple[DataFrame, float]:
    cells = materialize(docs.groupBy(*keys).agg(F.sum("tokens").cast("double").alias("tokens")))
    aimed = cells
    for key, d in zip(keys, DIMENSIONS, strict=True):
        aimed = aimed.join(level_targets(cells, key, targets.get(d), temper, fraction), key)
    return rake(materialize(aimed), keys, tolerance)


def mix_sources(
    docs: DataFrame, targets: dict[str, dict[str | None, float]] | None = None, fraction: float = 0.5, temper: float = 0.5,
    topic: Column | None = None, seed: int = 42, strict: bool = False,
) -> DataFrame:
    """A sample of docs whose expected tokens have the target shares by source, lang and topic at once; a Poisson sample,
    each document taken with its own probability p, a hash of doc_id and seed deciding.

    docs: doc_id, text, source, lang and any more. topic: an expression where the table has no such column. targets: shares
    by dimension and level (null allowed); by default each level's observed token share to the power `temper`, which lifts
    small levels. Levels without a target get none; targets of levels that are not there are shared out among the others,
    and if no level with a target is there, no document is taken. fraction: expected part of all tokens (white-space
    words) that is taken. A level can't give more tokens than it has: what its target asks beyond goes to the other levels
    by their shares. Where the targets of the dimensions still contradict one another, the sample is as near as fitting
    came, which is logged, or an error if `strict`. Adds topic, tokens and p. Null levels are a level; documents without
    tokens have their cell's p, 1 where the whole cell has none; repeated rows share their fate; an empty table gives no rows.
    """
    own = ["doc_id", "text", "source", "lang", *(["topic"] if "topic" in docs.columns else [])]
    if topic is None:
        topic = F.col("topic") if "topic" in docs.columns else topic_of(F.col("text"))
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\n]"), lambda w: w != "")).cast("long")
    marked = docs.withColumn("_topic", topic).transform(lambda d: packed(d, [*own, "_topic"])).withColumn("topic", F.col("_topic")).withColumn("tokens", words)
    keys = [f"_{d}" for d in DIMENSIONS]
    levelled = marked.withColumns({k: level(d) for k, d in zip(keys, DIMENSIONS, strict=True)})
    cells, miss = fitted_cells(levelled, keys, targets or {}, temper, fraction)
    if miss > 1e-3:
        if strict:
            raise ValueError(f"targets cannot be met together: a level is off by {miss:.2%} of the tokens to take")
        log.warning("targets cannot be met together: a level is off by %.2f %% of the tokens to take", 100 * miss)
    bare = (F.col("tokens") == 0) & reduce(lambda a, b: a & b, [F.lit((targets or {}).get(d) is None) for d in DIMENSIONS])
    odds = cells.select(F.xxhash64(*keys).alias("_cell"), *[F.col(k).alias(f"_c{k}") for k in keys], F.when(bare, 1.0).otherwise(F.least(F.lit(1.0), F.col("w"))).alias("p"))
    unit = F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed)), 11) / F.lit(float(1 << 53))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_c{k}") for k in keys])
    taken = skew_join(levelled.withColumn("_cell", F.xxhash64(*keys)), odds, ["_cell"]).filter(same & (unit < F.col("p")))
    return unpacked(taken, docs.columns, {n: F.col(n) for n in ("topic", "tokens", "p")})
