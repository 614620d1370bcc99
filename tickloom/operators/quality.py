"""The daily audit of bars against the slots that a scope, a calendar and a cutoff give: what is expected, missing, stale, explained.

A series is audited from its first bar's open to its last bar's close, or over the days asked for; days without a bar have their rows
too. Only slots that close by the cutoff count. Where a calendar is given, it says which slots are expected; else those between
the first and the last bar of a day are. Bars are shuffled once, by series and day, where a day's opens are one small array; the slots that
a day lacks are found there, and only they become rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.calendars import interval_states
from tickloom.operators.validate import incomplete, invalid_ohlc
from tickloom.schema import SERIES, floor_to, later, seconds, window_end
from tickloom.scratch import written

# Names of gap classes, and market states in the order in which a day takes the name of one of its slots.
GAP_CLASSES = ("known_gap", "scheduled_closure", "missing_data", "unknown_market_status")
STATUSES = ("open", "holiday", "maintenance", "weekend", "unknown")
SLOT = ["timestamp_open_utc", "market_status", "expected"]


@dataclass
class Audit:
    """What an audit is about. as_of: the cutoff. calendar: weekly hours and exceptions (calendars.weekly_windows, exceptions), or None.
    known: gaps with a reason (place, start_utc, end_utc, reason; instrument, source, timeframe, where null or absent stands for any), kept by hand.
    first_day and last_day ("2024-01-31"): the scope, both days included. declared: series (instrument, source) to audit though they may have no bar."""

    timeframe: str
    as_of: str | Column
    stale_after_minutes: int = 5
    calendar: tuple[DataFrame, DataFrame] | None = None
    known: DataFrame | None = None
    first_day: str | None = None
    last_day: str | None = None
    declared: DataFrame | None = None

    def __post_init__(self):
        if isinstance(self.as_of, str):
            self.as_of = F.lit(self.as_of).cast("timestamp")
        if self.stale_after_minutes < 0:
            raise ValueError("stale_after_minutes must not be negative")
        if self.declared is not None and not (self.first_day and self.last_day):
            raise ValueError("declared series need first_day and last_day: no scope is made up")
        if self.first_day and self.last_day and self.first_day > self.last_day:
            raise ValueError("first_day is after last_day")

    def closes(self, opened: Column) -> Column:
        return window_end(opened, self.timeframe)

    def grid(self) -> Column:
        """The slots that open on `day`."""
        start = F.col("day").cast("timestamp")
        if self.timeframe == "1mo":
            return F.when(F.dayofmonth("day") == 1, F.array(start)).otherwise(F.array().cast("array<timestamp>"))
        step = seconds(self.timeframe)
        return F.array(start) if step >= 86_400 else F.sequence(start, later(start, 1440) - F.expr(f"INTERVAL {step} SECONDS"), F.expr(f"INTERVAL {step} SECONDS"))


def audited_days(bars: DataFrame, audit: Audit) -> DataFrame:
    """A row a series and day of the scope: counts of its bars, observed (its opens, at most a day's slots) and slots (those in scope that
    close by the cutoff). Bars that open off the grid raise, for slots would be counted twice."""
    t = F.col("timestamp_open_utc")
    on_grid = F.when(t == floor_to(t, audit.timeframe), t).otherwise(F.raise_error(F.concat(F.lit(f"bars off the {audit.timeframe} grid: "), F.coalesce(t.cast("string"), F.lit("no time")))).cast("timestamp"))
    known = bars.withColumn("timestamp_open_utc", on_grid)
    late = incomplete(audit.as_of) | (audit.closes(t) > audit.as_of)
    found = known.groupBy(*SERIES, F.to_date("timestamp_open_utc").alias("day")).agg(
        F.count("*").alias("n_rows"), F.count_if(late).alias("n_incomplete"), F.count_if(invalid_ohlc()).alias("n_invalid"), F.collect_set("timestamp_open_utc").alias("observed")
    )
    found = written(found)
    spans = found.groupBy(*SERIES).agg(F.min(F.array_min("observed")).alias("_a"), F.max(F.array_max("observed")).alias("_b"))
    if audit.declared is not None:
        spans = spans.unionByName(audit.declared.select(*SERIES).distinct(), allowMissingColumns=True).groupBy(*SERIES).agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    first = F.lit(audit.first_day).cast("date") if audit.first_day else F.to_date("_a")
    last = F.lit(audit.last_day).cast("date") if audit.last_day else F.to_date("_b")
    opens = first.cast("timestamp") if audit.first_day else F.col("_a")
    ends = F.date_add(last, 1).cast("timestamp") if audit.last_day else audit.closes(F.col("_b"))
    scope = spans.select(*SERIES, opens.alias("_from"), ends.alias("_to"), F.explode(F.when(first <= last, F.sequence(first, last))).alias("day"))
    days = scope.join(found, [*SERIES, "day"], "left")
    slots = F.filter(audit.grid(), lambda s: (s >= F.col("_from")) & (s < F.col("_to")) & (audit.closes(s) <= audit.as_of))
    none = F.array().cast("array<timestamp>")
    return days.withColumns({"slots": slots, "observed": F.coalesce("observed", none), **{c: F.coalesce(c, F.lit(0)) for c in ("n_rows", "n_incomplete", "n_invalid")}}).drop("_from", "_to")


def calendar_slots(days: DataFrame, audit: Audit) -> DataFrame:
    """State and expectation of each slot that opens on one of the days, once for all series."""
    slots = days.select("day").distinct().select(F.explode(audit.grid()).alias("timestamp_open_utc"))
    return interval_states(slots, *audit.calendar, audit.timeframe)


def gap_slots(days: DataFrame, audit: Audit, states: DataFrame | None) -> DataFrame:
    """A row for each slot in scope without a bar: state, class, known_reason, counts_as_missing, is_stale."""
    lacking = days.select(*SERIES, "day", F.array_min("observed").alias("_low"), F.array_max("observed").alias("_high"), F.explode(F.array_except("slots", "observed")).alias("timestamp_open_utc"))
    if states is None:
        inside = F.coalesce(F.col("timestamp_open_utc").between(F.col("_low"), F.col("_high")), F.lit(False))
        lacking = lacking.withColumns({"market_status": F.lit("unknown"), "expected": F.lit(None).cast("boolean"), "_missing": inside})
    else:
        lacking = lacking.join(states, "timestamp_open_utc").withColumn("_missing", F.col("expected"))
    t = F.col("timestamp_open_utc")
    reason = F.lit(None).cast("string")
    if audit.known is not None:
        optional = {c: F.col(c) if c in audit.known.columns else F.lit(None).cast("string") for c in (*SERIES, "timeframe")}
        entry = F.struct("place", "reason", "start_utc", "end_utc", *[v.alias(k) for k, v in optional.items()])
        listed = audit.known.filter(optional["timeframe"].isNull() | (optional["timeframe"] == audit.timeframe)).select(entry.alias("_gap"), F.explode(F.sequence(F.to_date("start_utc"), F.to_date("end_utc"))).alias("day"))
        lacking = lacking.join(listed.groupBy("day").agg(F.collect_list("_gap").alias("_gaps")), "day", "left")
        fits = lambda own, asked: asked.isNull() | (asked == F.col(own))
        holds = lambda g: (t >= g["start_utc"]) & (t < g["end_utc"]) & fits("instrument", g["instrument"]) & fits("source", g["source"])
        reason = F.array_min(F.filter("_gaps", holds))["reason"]
    lacking = lacking.withColumn("known_reason", reason)
    named = F.when(F.col("known_reason").isNotNull(), "known_gap").when(~F.col("expected"), "scheduled_closure").when(F.col("expected"), "missing_data").otherwise("unknown_market_status")
    stale = F.col("_missing") & (later(audit.closes(t), audit.stale_after_minutes) <= audit.as_of)
    return lacking.select(*SERIES, "day", *SLOT, "known_reason", named.alias("classification"), F.col("_missing").alias("counts_as_missing"), stale.alias("is_stale"))


def gap_records(slots: DataFrame, audit: Audit) -> DataFrame:
    """Runs of adjacent slots of one day that are alike in state, class, reason, and in whether they count and are stale."""
    alike = ["market_status", "classification", "known_reason", "counts_as_missing", "is_stale"]
    w = Window.partitionBy(*SERIES, "day").orderBy("timestamp_open_utc")
    new = (F.lag(audit.closes(F.col("timestamp_open_utc"))).over(w) != F.col("timestamp_open_utc")) | ~F.lag(F.struct(*alike)).over(w).eqNullSafe(F.struct(*alike))
    marked = slots.withColumn("_id", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w))
    runs = marked.groupBy(*SERIES, "day", "_id", *alike).agg(F.min("timestamp_open_utc").alias("gap_start_utc"), F.max("timestamp_open_utc").alias("_last"), F.count("*").alias("n_slots"))
    return runs.withColumn("gap_end_utc", audit.closes(F.col("_last"))).drop("_id", "_last")


def daily_quality(bars: DataFrame, audit: Audit) -> DataFrame:
    """One row a series and UTC day of the scope: rows, distinct bars, expected, missing and stale slots, incomplete (also those that close after the
    cutoff), duplicate and invalid bars, gaps by class, the day's market state, and a status: fail for invalid, duplicate or incomplete
    bars and for gaps that nothing explains (missing_data), marked for all other gaps, else pass."""
    days = audited_days(bars, audit)
    states = calendar_slots(days, audit) if audit.calendar else None
    slots = gap_slots(days, audit, states)
    gaps = gap_records(slots, audit).groupBy(*SERIES, "day").agg(
        F.coalesce(F.sum(F.when(F.col("counts_as_missing"), F.col("n_slots"))), F.lit(0)).alias("n_missing"), F.coalesce(F.sum(F.when(F.col("is_stale"), F.col("n_slots"))), F.lit(0)).alias("n_stale"),
        *[F.count_if(F.col("classification") == c).alias(f"n_{c}") for c in GAP_CLASSES],
    )
    out = days.withColumn("n_distinct", F.size("observed"))
    if states is None:
        low, high = F.array_min("observed"), F.array_max("observed")
        out = out.withColumns({"n_expected": F.size(F.filter("slots", lambda s: s.between(low, high))), "market_status": F.lit("unknown")})
    else:
        per_day = states.groupBy(F.to_date("timestamp_open_utc").alias("day")).agg(F.collect_list(F.struct(*SLOT)).alias("_states"))  # a day's slots
        inside = F.filter("_states", lambda s: (s["timestamp_open_utc"] >= F.array_min("slots")) & (s["timestamp_open_utc"] <= F.array_max("slots")))
        out = out.join(per_day, "day", "left").withColumn("_states", inside)
        present = F.array_intersect(F.array(*[F.lit(s) for s in STATUSES]), F.transform("_states", lambda s: s["market_status"]))
        status = F.coalesce(F.get(present, F.lit(0)), F.lit("unknown"))
        out = out.withColumns({"n_expected": F.coalesce(F.size(F.filter("_states", lambda s: s["expected"])), F.lit(0)), "market_status": status}).drop("_states")
    counted = {c: F.coalesce(c, F.lit(0)) for c in ("n_missing", "n_stale", *[f"n_{g}" for g in GAP_CLASSES])}
    whole = out.join(gaps, [*SERIES, "day"], "left").withColumns(counted).withColumns({"n_expected": F.col("n_expected").cast("long"), "n_distinct": F.col("n_distinct").cast("long"), "n_duplicate": F.col("n_rows") - F.col("n_distinct")})
    any_of = lambda *names: F.greatest(*[F.col(n) for n in names]) > 0
    status = F.when(any_of("n_invalid", "n_duplicate", "n_incomplete", "n_missing_data"), "fail").when(any_of("n_known_gap", "n_scheduled_closure", "n_unknown_market_status"), "marked").otherwise("pass")
    return whole.withColumn("quality_status", status).drop("slots", "observed")


def gap_report(bars: DataFrame, audit: Audit) -> DataFrame:
    """All gaps of the audit."""
    days = audited_days(bars, audit)
    return gap_records(gap_slots(days, audit, calendar_slots(days, audit) if audit.calendar else None), audit)
