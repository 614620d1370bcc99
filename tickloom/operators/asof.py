"""As-of joins: the latest right row at or before each left row, no older than a bound."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.schema import SERIES, seconds


def asof_on_grid(left: DataFrame, right: DataFrame, timeframe: str, names: list[str], multiplier: float = 1.0, time: str = "prediction_time_utc", right_time: str = "available_at_utc") -> DataFrame:
    """left with right's columns of its latest row with 0 <= age <= timeframe * multiplier, else null; all left rows stay.

    Right rows stand on the timeframe's grid, so only the grid times within the bound can match: equi-joins, newest
    first, no window over a whole series.
    """
    step = seconds(timeframe)
    at = F.unix_seconds(time)
    floor = at - F.pmod(at, F.lit(step))
    facts = right.select(*SERIES, F.unix_seconds(right_time).alias("_at"), F.struct(F.col(right_time).alias("_t"), *names).alias("_f"))
    out = left.withColumn("_floor", floor)
    candidates = math.floor(multiplier) + 1
    for k in range(candidates):
        out = out.withColumn("_at", F.col("_floor") - k * step).join(facts.withColumnRenamed("_f", f"_f{k}"), [*SERIES, "_at"], "left").drop("_at")
    best = F.coalesce(*[F.col(f"_f{k}") for k in range(candidates)])
    fresh = F.unix_micros(time) - F.unix_micros(best["_t"]) <= int(step * multiplier * 1_000_000)
    out = out.withColumn("_best", F.when(fresh, best))
    return out.select(*left.columns, *[F.col(f"_best.{n}").alias(n) for n in names], F.col("_best._t").alias(f"asof_{timeframe}_utc"))


def asof_general(left: DataFrame, right: DataFrame, names: list[str], tolerance_seconds: int, time: str = "prediction_time_utc", right_time: str = "available_at_utc") -> DataFrame:
    """The same for right rows at any times: both sides in one ordered series, the last right row carried forward. Series are
    cut into spans of the tolerance, and right rows also enter the next span, so that no task holds a whole series."""
    span = lambda c: F.floor(F.unix_seconds(c) / tolerance_seconds)
    facts = right.select(*SERIES, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(right_time).alias("_t"), *names).alias("_f"), F.explode(F.array(span(right_time), span(right_time) + 1)).alias("_span"))
    asked = left.select(*SERIES, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(facts.schema["_f"].dataType).alias("_f"), span(time).alias("_span"), F.struct(*left.columns).alias("_row"))
    both = facts.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)).unionByName(asked)
    w = Window.partitionBy(*SERIES, "_span").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_f", ignorenulls=True).over(w)).filter("_side = 1")
    fresh = F.unix_micros("_t") - F.unix_micros("_last._t") <= tolerance_seconds * 1_000_000
    found = found.withColumn("_last", F.when(fresh, F.col("_last")))
    return found.select("_row.*", *[F.col(f"_last.{n}").alias(n) for n in names], F.col("_last._t").alias("asof_utc"))


def asof_many(left: DataFrame, rights: dict[str, tuple[DataFrame, list[str], int]], time: str = "prediction_time_utc", right_time: str = "available_at_utc") -> DataFrame:
    """left with the columns of several right tables, each by its latest row no older than its tolerance: rights by name, as (rows, columns,
    tolerance in seconds); asof_<name>_utc is that row's time. One exchange and one sort serve all: the sides become one ordered series, each table's
    last row is carried forward in a column of its own. Series are cut into days, and a right row also enters each later day that it may be fresh in."""
    day = lambda c: F.floor(F.unix_seconds(c) / 86_400)
    facts = {k: F.struct(F.col(right_time).alias("_t"), *names) for k, (_, names, _) in rights.items()}
    kinds = {k: rows.select(facts[k].alias("f")).schema["f"].dataType for k, (rows, _, _) in rights.items()}
    whole = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    row_kind = left.select(whole.alias("r")).schema["r"].dataType
    none = lambda kind: F.lit(None).cast(kind)
    both = left.select(*SERIES, F.col(time).alias("_at"), F.lit(1).alias("_side"), day(time).alias("_day"), whole.alias("_row"), *[none(kinds[k]).alias(f"_{k}") for k in rights])
    for k, (rows, _, tolerance) in rights.items():
        until = F.floor((F.unix_seconds(right_time) + tolerance) / 86_400)
        both = both.unionByName(rows.select(*SERIES, F.col(right_time).alias("_at"), F.lit(0).alias("_side"), F.explode(F.sequence(day(right_time), until)).alias("_day"), none(row_kind).alias("_row"), *[(facts[k] if j == k else none(kinds[j])).alias(f"_{j}") for j in rights]))
    w = Window.partitionBy(*SERIES, "_day").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({f"_{k}": F.last(f"_{k}", ignorenulls=True).over(w) for k in rights}).filter("_side = 1")
    fresh = {f"_{k}": F.when(F.unix_micros("_at") - F.unix_micros(f"_{k}._t") <= tolerance * 1_000_000, F.col(f"_{k}")) for k, (_, _, tolerance) in rights.items()}
    found = found.withColumns(fresh)
    return found.select("_row.*", *[x for k, (_, names, _) in rights.items() for x in (*[F.col(f"_{k}.{n}").alias(n) for n in names], F.col(f"_{k}._t").alias(f"asof_{k}_utc"))])
