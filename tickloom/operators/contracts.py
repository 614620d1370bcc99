"""Contracts of the tables between steps, as one row of violation counts each, and column choices by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.bars import class_id
from tickloom.schema import SERIES


def blank(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)) == "", F.lit(True))


def finite(name: str) -> Column:
    return F.coalesce(~F.isnan(name) & (F.abs(F.col(name)) < float("inf")), F.lit(False))


def require_clean(counts: DataFrame, what: str) -> None:
    """An error that names every count but n_rows that is not zero."""
    if found := {k: v for k, v in counts.first().asDict().items() if v and k != "n_rows"}:
        raise ValueError(f"{what}: {found}")


def candidate_violations(candidates: DataFrame, minutes: int = 3) -> DataFrame:
    """Candidates with an empty or null name, with a time off the UTC grid, and rows beyond the first of their key."""
    per = candidates.groupBy(*SERIES, "prediction_time_utc").agg(F.count("*").alias("n"))
    off = F.coalesce(F.unix_micros("prediction_time_utc") % (minutes * 60_000_000) != 0, F.lit(True))
    count = lambda bad: F.coalesce(F.sum(F.when(bad, F.col("n")).otherwise(0)), F.lit(0))
    return per.agg(count(F.lit(True)).alias("n_rows"), count(blank("instrument") | blank("source")).alias("n_unnamed"), count(off).alias("n_off_grid"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeated"))


def ask_violations(bars: DataFrame) -> DataFrame:
    """Observed asks that are not finite, not above zero, or below the bid."""
    ask = F.col("ask_open")
    below = finite("ask_open") & F.coalesce(ask < F.col("bid_open"), F.lit(False))
    return bars.agg(F.count("*").alias("n_rows"), F.count_if(~finite("ask_open")).alias("n_not_finite"), F.count_if(finite("ask_open") & (ask <= 0)).alias("n_not_positive"), F.count_if(below).alias("n_below_bid"))


def target_violations(rows: DataFrame) -> DataFrame:
    """Classes that aren't known or disagree with their id, returns that aren't finite, and empty or repeated sample ids."""
    disagree = F.coalesce(class_id(F.col("target_class")) != F.col("target_class_id"), F.lit(True))
    per = rows.groupBy("sample_id").agg(F.count("*").alias("n"), F.count_if(disagree).alias("bad"), F.count_if(~finite("arithmetic_return_bps")).alias("wild"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(total("n").alias("n_rows"), total("bad").alias("n_class_mismatch"), total("wild").alias("n_return_not_finite"), total(F.when(blank("sample_id"), F.col("n")).otherwise(0)).alias("n_empty_id"), total(F.col("n") - 1).alias("n_repeated_id"))


# fixed values: what marks a column as one to audit by
AUDIT_NAMES = ["sample_id", "instrument", "source", "horizon_minutes", "arithmetic_return_bps", "fold"]
AUDIT_ENDS, AUDIT_STARTS = ("_utc", "_version"), ("entry_", "exit_", "target_", "future_")


def audit_records(rows: DataFrame) -> DataFrame:
    """The columns that tell where a prediction came from and what followed; feature values stay in their table."""
    return rows.select(*[c for c in rows.columns if c in AUDIT_NAMES or c.endswith(AUDIT_ENDS) or c.startswith(AUDIT_STARTS) or "hash" in c])


def require_allowed(names: list[str], allowed: list[str]) -> list[str]:
    """Names of features, each once and all in the list; else an error."""
    strangers = sorted(set(names) - set(allowed))
    if not names or len(set(names)) < len(names) or strangers:
        raise ValueError(f"no allowed set of features: {strangers or 'none, or one named twice'}")
    return names


def unmatched(predictions: DataFrame, targets: DataFrame, key: str = "sample_id") -> DataFrame:
    """Predictions without a target; require that none are left before metrics are taken."""
    return predictions.join(targets.select(key), key, "left_anti")


def parity(reference: DataFrame, universe: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """One row: how the frozen reference, cut down to the universe's samples, agrees with it. Counts of samples it lacks, holds more than once,
    or tells another time, class or return for."""
    told = ["prediction_time_utc", "target_class_id", "arithmetic_return_bps"]
    sides = reference.join(universe.select("sample_id").distinct(), "sample_id", "left_semi").select("sample_id", *told, F.lit(1).alias("_r"), F.lit(0).alias("_u"))
    both = sides.unionByName(universe.select("sample_id", *told, F.lit(0).alias("_r"), F.lit(1).alias("_u")))
    side = lambda c, s: F.max(F.when(F.col(s) == 1, F.col(c)))
    per = both.groupBy("sample_id").agg(F.sum("_r").alias("r"), F.sum("_u").alias("u"), *[side(c, s).alias(c + s) for c in told for s in ("_r", "_u")])
    there = F.col("r") > 0
    off = lambda c: there & ~F.col(c + "_r").eqNullSafe(F.col(c + "_u"))
    far = there & F.coalesce(F.abs(F.col(told[2] + "_r") - F.col(told[2] + "_u")) > tolerance, F.lit(True))
    return per.agg(F.count("*").alias("n_rows"), F.count_if(~there).alias("n_missing"), F.count_if((F.col("r") > 1) | (F.col("u") > 1)).alias("n_repeated"), F.count_if(off(told[0])).alias("n_time"), F.count_if(off(told[1])).alias("n_class"), F.count_if(far).alias("n_return"))


def restricted(reference: DataFrame, universe: DataFrame) -> DataFrame:
    """The reference's rows of the universe's samples."""
    return reference.join(universe.select("sample_id"), "sample_id", "left_semi")
