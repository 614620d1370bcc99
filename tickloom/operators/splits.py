"""Time splits that cannot leak: purge gaps, walk-forward folds, guards, and train-only statistics."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.scratch import written


@dataclass(frozen=True)
class Block:
    """Predictions in [start, end) less the gap before the end, with labels that mature before the end. Bounds are times, or
    columns of the rows where they follow from the data."""

    name: str
    start: datetime | Column
    end: datetime | Column

    def __post_init__(self):
        if isinstance(self.start, datetime) and isinstance(self.end, datetime) and self.start >= self.end:
            raise ValueError(f"{self.name}: empty block")

    def predicate(self, gap_minutes: int, purge: bool = True) -> Column:
        end = before(self.end, gap_minutes) if purge else utc(self.end)
        inside = (F.col("prediction_time_utc") >= utc(self.start)) & (F.col("prediction_time_utc") < end)
        return inside & (F.col("label_end_time_utc") < utc(self.end)) if purge else inside


@dataclass(frozen=True)
class Fold:
    name: str
    train: Block
    calibration: Block
    test: Block
    inner: tuple[tuple[Block, Block], ...] = ()


def utc(t: datetime | Column) -> Column:
    return t if isinstance(t, Column) else F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def before(t: datetime | Column, minutes: int) -> Column:
    return utc(t) - F.make_dt_interval(mins=F.lit(minutes))


def calendar_folds(test_years: tuple[int, ...] = (2022, 2023, 2024), start_year: int = 2020) -> list[Fold]:
    """Expanding outer folds: train up to the year before's last quarter, which is for calibration, test a year; inner
    validations are the second and third quarter of the last training year."""
    day = lambda y, m: datetime(y, m, 1)
    out = []
    for y in sorted(test_years):
        inner = tuple((Block(f"{y}-inner-train-q{q}", day(start_year, 1), day(y - 1, 3 * q - 2)), Block(f"{y}-inner-q{q}", day(y - 1, 3 * q - 2), day(y - 1, 3 * q + 1))) for q in (2, 3))
        out.append(Fold(str(y), Block(f"{y}-train", day(start_year, 1), day(y - 1, 10)), Block(f"{y}-calibration", day(y - 1, 10), day(y, 1)), Block(f"{y}-test", day(y, 1), day(y + 1, 1)), inner))
    return out


def day_folds(first: datetime, train_days: int, calibration_days: int, test_days: int, count: int) -> list[Fold]:
    """The same shape on days, for short series."""
    out = []
    for i in range(count):
        a = first + timedelta(days=train_days + i * test_days)
        b = a + timedelta(days=calibration_days)
        out.append(Fold(f"f{i}", Block(f"f{i}-train", first, a), Block(f"f{i}-calibration", a, b), Block(f"f{i}-test", b, b + timedelta(days=test_days))))
    return out


def required_gap_minutes(horizons: tuple[int, ...], latency_minutes: int = 1) -> int:
    return max(horizons) + latency_minutes


def select_block(rows: DataFrame, block: Block, gap_minutes: int, purge: bool = True) -> DataFrame:
    return rows.filter(block.predicate(gap_minutes, purge))


def assign_blocks(rows: DataFrame, blocks: list[Block], gap_minutes: int) -> DataFrame:
    """Each row once for every block that takes it in: blocks are a few predicates, not a join."""
    names = F.array_compact(F.array(*[F.when(b.predicate(gap_minutes), F.lit(b.name)) for b in blocks]))
    return rows.withColumn("block", F.explode(names))


def assign_split(rows: DataFrame, train_end: datetime | Column, validation_end: datetime | Column, test_end: datetime | Column, gap_minutes: int) -> DataFrame:
    """split: train, validation or test; the gap before each boundary belongs to none, and rows of none are left out."""
    t, last = F.col("prediction_time_utc"), lambda end: before(end, gap_minutes)
    split = F.when(t < last(train_end), "train").when((t >= utc(train_end)) & (t < last(validation_end)), "validation").when((t >= utc(validation_end)) & (t < last(test_end)), "test")
    return rows.withColumn("split", split).filter("split IS NOT NULL")


def guard_violations(rows: DataFrame, guard: datetime) -> DataFrame:
    """One row: for every time column how many values reach the guard, as columns n_<name>."""
    times = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return rows.agg(*[F.count_if(F.col(c) >= utc(guard)).alias(f"n_{c}") for c in times])


def require_before(rows: DataFrame, guard: datetime) -> DataFrame:
    found = {k: v for k, v in guard_violations(rows, guard).first().asDict().items() if v}
    if found:
        raise ValueError(f"rows at or after {guard:%Y-%m-%d}: {found}")
    return rows


def _ordered(name: str) -> Column:
    """Values for sketches and comparisons: NaN, which is larger than any, as infinity."""
    return F.nanvl(F.col(name).cast("double"), F.lit(float("inf")))


def with_brackets(rows: DataFrame, names: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """rows with <name>__b, for each group two values that its median lies between, closely: what medians() needs."""
    near = rows.groupBy(*by).agg(*[F.percentile_approx(_ordered(n), [0.499, 0.501], 10_000).alias(f"{n}__b") for n in names])
    return rows.join(F.broadcast(near), by) if by else rows.join(F.broadcast(near))


def bracketed(name: str) -> Column:
    """An aggregate of with_brackets' rows for median(): how many values are there, below and at the lower end, at the upper end, and the
    few between them. So no task holds a group's different values, as F.percentile does."""
    x, low, high = _ordered(name), F.col(f"{name}__b")[0], F.col(f"{name}__b")[1]
    inside = F.array_sort(F.collect_list(F.when((x > low) & (x < high), x)))
    return F.struct(F.count(x).alias("n"), F.count_if(F.isnan(name)).alias("nan"), F.count_if(x < low).alias("below"), F.count_if(x == low).alias("low"), F.count_if(x == high).alias("high"), F.min(low).alias("a"), F.min(high).alias("b"), inside.alias("inside"))


def median(m: Column) -> Column:
    """The exact median that F.percentile gives, from bracketed(): null where nothing is there."""
    first = m["below"] + m["low"]

    def at(rank: Column) -> Column:
        place = rank - first
        return (
            F.when(rank >= m["n"] - m["nan"], float("nan")).when((rank >= m["below"]) & (rank < first), m["a"]).when((place >= 0) & (place < F.size(m["inside"])), F.get(m["inside"], place.cast("int")))
            .when((place >= F.size(m["inside"])) & (place < F.size(m["inside"]) + m["high"]), m["b"]).otherwise(F.raise_error(F.lit("a median lies outside its bracket")).cast("double"))
        )

    low, high = at(F.floor((m["n"] - 1) / 2)), at(F.floor(m["n"] / 2))
    return F.when(m["n"] > 0, F.when(low == high, low).otherwise(0.5 * low + 0.5 * high))


def impute_scale_stats(rows: DataFrame, names: list[str]) -> DataFrame:
    """(feature, median, mean, scale) of the given rows only: exact median of what is there, then mean and population
    deviation of the imputed values; a scale of 0 counts as 1. What imputing does to mean and deviation follows from the
    number of missing values, the median, and the moments of what is there. Two passes over the features, which are written once."""
    rows = with_brackets(written(rows.select(*names)), names)
    sums = lambda n: [bracketed(n).alias(f"{n}__k"), F.count(n).alias(f"{n}__n"), F.avg(n).alias(f"{n}__a"), F.stddev_pop(n).alias(f"{n}__s")]
    wide = rows.agg(F.count("*").alias("__all"), *[x for n in names for x in sums(n)])
    wide = wide.withColumns({f"{n}__m": median(F.col(f"{n}__k")) for n in names})

    col = lambda n, k: F.col(f"{n}__{k}")
    share = {n: F.try_divide(col(n, "n"), F.col("__all")) for n in names}
    means = wide.withColumns({f"{n}__w": share[n] * col(n, "a") + (1 - share[n]) * col(n, "m") for n in names})
    square = lambda x: x * x
    scales = means.withColumns({f"{n}__d": F.sqrt(share[n] * (square(col(n, "s")) + square(col(n, "a") - col(n, "w"))) + (1 - share[n]) * square(col(n, "m") - col(n, "w"))) for n in names})
    one = lambda n: F.struct(F.lit(n).alias("feature"), col(n, "m").alias("median"), col(n, "w").alias("mean"), F.when(col(n, "d") == 0, 1.0).otherwise(col(n, "d")).alias("scale"))
    return scales.select(F.inline(F.array(*[one(n) for n in names])))


def standardized(rows: DataFrame, stats: DataFrame, names: list[str]) -> DataFrame:
    """Missing values become the median, then all are scaled; stats are one row a feature."""
    known = {r.feature: r for r in stats.collect()}
    return rows.withColumns({n: (F.coalesce(F.col(n), F.lit(known[n]["median"])) - F.lit(known[n]["mean"])) / F.lit(known[n]["scale"]) for n in names})


def unstandardized(rows: DataFrame, stats: DataFrame, names: list[str]) -> DataFrame:
    """Scaled values as they were: the inverse of standardized, but for values that were missing."""
    known = {r.feature: r for r in stats.collect()}
    return rows.withColumns({n: F.col(n) * F.lit(known[n]["scale"]) + F.lit(known[n]["mean"]) for n in names})


def distribution(rows: DataFrame, names: list[str], by: str = "split") -> DataFrame:
    """Count, nulls, mean, population deviation and percentiles of each feature in each part."""
    long = rows.select(by, F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])))
    p = F.percentile("value", [0.05, 0.5, 0.95])
    grouped = long.groupBy(by, "feature").agg(F.count("*").alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_null"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), p.alias("p"))
    return grouped.select(by, "feature", "n_rows", "n_null", "mean", "std", *[F.col("p")[i].alias(k) for i, k in enumerate(("p05", "p50", "p95"))])


def mean_shift(dist: DataFrame, by: str = "split", base: str = "train", other: str = "test") -> DataFrame:
    """How far each feature's mean moves from base to other, in base deviations."""
    side = lambda s, p: dist.filter(F.col(by) == s).select("feature", F.col("mean").alias(f"{p}_mean"), F.col("std").alias(f"{p}_std"))
    return side(base, "base").join(side(other, "other"), "feature").select("feature", F.try_divide(F.col("other_mean") - F.col("base_mean"), F.col("base_std")).alias("mean_shift"))


def class_weights(rows: DataFrame, target: str = "target_class") -> DataFrame:
    """n / (number of classes * rows of the class)."""
    counts = rows.groupBy(target).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.join(F.broadcast(whole)).select(target, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"), (F.col("n") / F.col("total")).alias("prior"))
