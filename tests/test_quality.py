"""The daily audit: scope, cutoff, calendar, known gaps, declared series, months."""

from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from tickloom.operators import calendars, quality
from tickloom.schema import window_end
from tickloom.session import in_utc


def bars(spark, opens, timeframe="1min", source="s"):
    rows = [("I", source, timeframe, datetime.fromisoformat(t).replace(tzinfo=timezone.utc), 10.0, 12.0, 9.0, 11.0, True) for t in opens]
    frame = in_utc(spark).createDataFrame(rows, "instrument string, source string, timeframe string, timestamp_open_utc timestamp, bid_open double, bid_high double, bid_low double, bid_close double, is_complete boolean")
    return frame.withColumn("timestamp_close_utc", window_end(F.col("timestamp_open_utc"), timeframe))


def week(spark, special=(), hours=None):
    return calendars.weekly_windows(spark, hours or [(d, 0, 1440) for d in range(5)]), calendars.exceptions(spark, list(special) or [("holiday", "1999-01-01 00:00:00", "1999-01-01 00:00:01")])


def days(frame, audit):
    return {r.day: r for r in quality.daily_quality(frame, audit).collect()}


def gaps(frame, audit):
    return sorted(quality.gap_report(frame, audit).collect(), key=lambda g: (g.source, g.gap_start_utc))


def test_four_bars_over_days_and_a_cutoff(spark):
    found = days(bars(spark, ["2024-01-01 23:58", "2024-01-04 00:01", "2024-01-04 00:02", "2024-01-04 00:09"]), quality.Audit("1min", "2024-01-04 00:05:00"))
    assert sorted(found) == [date(2024, 1, d) for d in (1, 2, 3, 4)]
    first, last = found[date(2024, 1, 1)], found[date(2024, 1, 4)]
    assert (first.n_rows, first.n_expected, first.n_missing, first.n_unknown_market_status, first.quality_status) == (1, 1, 0, 1, "marked")
    for d in (2, 3):
        r = found[date(2024, 1, d)]
        assert (r.n_rows, r.n_expected, r.n_missing, r.n_stale, r.n_unknown_market_status, r.quality_status) == (0, 0, 0, 0, 1, "marked")
    assert (last.n_expected, last.n_missing, last.n_incomplete, last.n_unknown_market_status, last.quality_status) == (4, 2, 1, 2, "fail")


def test_defects_of_rows_are_counted(spark):
    frame = bars(spark, ["2024-01-02 00:00", "2024-01-02 00:02", "2024-01-02 00:03", "2024-01-02 00:03"])
    minute = F.minute("timestamp_open_utc")
    frame = frame.withColumns({"is_complete": minute != 2, "bid_high": F.when(minute == 0, 9.5).otherwise(12.0)})
    (r,) = days(frame, quality.Audit("1min", "2024-01-03")).values()
    assert (r.n_rows, r.n_distinct, r.n_expected, r.n_missing, r.n_stale, r.n_incomplete, r.n_duplicate, r.n_invalid, r.quality_status) == (4, 3, 4, 1, 1, 1, 1, 1, "fail")


def test_a_weekend_is_a_closure_and_a_lost_minute_is_not(spark):
    audit = quality.Audit("1min", "2024-01-09", calendar=week(spark))
    frame = bars(spark, ["2024-01-05 23:59", "2024-01-08 00:01"])
    found = days(frame, audit)
    assert [found[date(2024, 1, d)].market_status for d in (5, 6, 7, 8)] == ["open", "weekend", "weekend", "open"]
    assert [found[date(2024, 1, d)].n_expected for d in (6, 7)] == [0, 0]
    assert (found[date(2024, 1, 8)].n_missing, found[date(2024, 1, 8)].n_missing_data, found[date(2024, 1, 8)].quality_status, found[date(2024, 1, 6)].quality_status) == (1, 1, "fail", "marked")
    assert [(g.classification, g.counts_as_missing, g.is_stale, g.n_slots) for g in gaps(frame, audit)] == [("scheduled_closure", False, False, 1440)] * 2 + [("missing_data", True, True, 1)]


@pytest.mark.parametrize(("timeframe", "classed"), [("1min", "known_gap"), ("3min", "missing_data"), (None, "known_gap")])
def test_a_known_gap_explains_what_is_missing(spark, timeframe, classed):
    known = spark.createDataFrame([(1, "outage", "I", timeframe)], "place int, reason string, instrument string, timeframe string").selectExpr("*", "TIMESTAMP '2024-01-08 00:01:00' AS start_utc", "TIMESTAMP '2024-01-08 00:02:00' AS end_utc")
    audit = quality.Audit("1min", "2024-01-09", 0, calendar=week(spark), known=known)
    frame = bars(spark, ["2024-01-08 00:00", "2024-01-08 00:02"])
    (g,) = [g for g in gaps(frame, audit)]
    assert (g.classification, g.counts_as_missing, g.is_stale, g.known_reason) == (classed, True, True, "outage" if classed == "known_gap" else None)
    (r,) = days(frame, audit).values()
    assert (r.n_missing, r.quality_status) == (1, "marked" if classed == "known_gap" else "fail")


def test_exceptions_come_before_open_hours(spark):
    special = [("holiday", "2024-01-09 00:00:00", "2024-01-10 00:00:00"), ("maintenance", "2024-01-08 00:01:00", "2024-01-08 00:02:00")]
    audit = quality.Audit("1min", "2024-01-11", calendar=week(spark, special))
    frame = bars(spark, ["2024-01-08 00:00", "2024-01-10 00:00"])
    found = days(frame, audit)
    assert (found[date(2024, 1, 9)].market_status, found[date(2024, 1, 9)].n_expected, found[date(2024, 1, 8)].n_expected) == ("holiday", 0, 1439)
    assert {g.classification for g in gaps(frame, audit) if g.market_status != "open"} == {"scheduled_closure"}


def test_scope_with_days_without_bars(spark):
    found = days(bars(spark, ["2024-01-02 12:00"]), quality.Audit("1min", "2024-01-04", 0, first_day="2024-01-01", last_day="2024-01-03"))
    assert len(found) == 3 and all(r.market_status == "unknown" and r.n_missing == 0 for r in found.values())
    assert [found[date(2024, 1, d)].n_expected for d in (1, 2, 3)] == [0, 1, 0] and found[date(2024, 1, 2)].n_unknown_market_status == 2


def test_nothing_after_the_cutoff_is_missing(spark):
    audit = quality.Audit("1min", "2024-01-08 00:02:30", 0, calendar=week(spark), last_day="2024-01-08")
    (r,) = days(bars(spark, ["2024-01-08 00:00"]), audit).values()
    assert (r.n_expected, r.n_missing) == (2, 1)
    (g,) = gaps(bars(spark, ["2024-01-08 00:00"]), audit)
    assert g.gap_end_utc == datetime(2024, 1, 8, 0, 2)


def test_months(spark):
    open_month = days(bars(spark, ["2024-02-01 00:00"], "1mo"), quality.Audit("1mo", "2024-02-29 23:59:59", 0))[date(2024, 2, 1)]
    assert (open_month.n_incomplete, open_month.quality_status, open_month.n_expected, open_month.n_missing) == (1, "fail", 0, 0)
    (leap,) = gaps(bars(spark, ["2024-01-01 00:00", "2024-03-01 00:00"], "1mo"), quality.Audit("1mo", "2024-04-01", 0))
    assert (leap.gap_start_utc, leap.gap_end_utc, leap.n_slots, leap.classification) == (datetime(2024, 2, 1), datetime(2024, 3, 1), 1, "unknown_market_status")
    audit = quality.Audit("1mo", "2024-08-01", 0, calendar=week(spark))
    june = days(bars(spark, ["2024-05-01 00:00", "2024-07-01 00:00"], "1mo"), audit)[date(2024, 6, 1)]  # a Saturday
    assert (june.market_status, june.n_expected, june.n_missing, june.n_missing_data) == ("open", 1, 1, 1)


def test_partly_open_intervals(spark):
    calendar = week(spark, hours=[(6, 1350, 1440)])
    slots = in_utc(spark).createDataFrame([(datetime(2024, 1, 7, 22, tzinfo=timezone.utc),), (datetime(2024, 1, 7, tzinfo=timezone.utc),)], "timestamp_open_utc timestamp")
    states = lambda t: {r.timestamp_open_utc.hour: (r.market_status, r.expected) for r in calendars.interval_states(slots, *calendar, t).collect()}
    assert states("1h")[22][1] is False  # Sundays count as weekend here
    open_sunday = lambda t: calendars.states(slots, *calendar, weekend=(5,))
    assert {r.market_status for r in open_sunday("1h").collect()} == {"unknown"}


def test_declared_series_without_a_bar(spark):
    nothing = bars(spark, ["2024-01-01 00:00"], "1d").limit(0)
    declared = spark.createDataFrame([("I", "other"), ("I", "other")], "instrument string, source string")
    audit = quality.Audit("1d", "2024-01-09", 0, calendar=week(spark), first_day="2024-01-06", last_day="2024-01-08", declared=declared)
    found = days(nothing, audit)
    assert [found[date(2024, 1, d)].n_expected for d in (6, 7, 8)] == [0, 0, 1] and found[date(2024, 1, 8)].quality_status == "fail"
    month = quality.Audit("1mo", "2024-03-01", 0, first_day="2024-02-01", last_day="2024-02-29", declared=declared)
    assert len(days(nothing, month)) == 29 and [(g.gap_start_utc, g.counts_as_missing) for g in gaps(nothing, month)] == [(datetime(2024, 2, 1), False)]
    both = days(bars(spark, ["2024-01-08 00:00"], "1d", "other"), audit)
    assert len(both) == 3 and both[date(2024, 1, 8)].n_missing == 0
    assert quality.daily_quality(nothing, quality.Audit("1d", "2024-01-09")).count() == 0
    with pytest.raises(ValueError, match="first_day and last_day"):
        quality.Audit("1d", "2024-01-09", declared=declared)
    with pytest.raises(ValueError, match="after"):
        quality.Audit("1d", "2024-01-09", first_day="2024-01-02", last_day="2024-01-01")


@pytest.mark.parametrize("timeframe", ["1min", "1h", "1d", "1mo"])
def test_bars_off_the_grid_are_refused(spark, timeframe):
    with pytest.raises(Exception, match="off the"):
        days(bars(spark, ["2024-01-02 00:00:01"], timeframe), quality.Audit(timeframe, "2024-02-01"))


def test_year_boundary_and_two_sources(spark):
    frame = bars(spark, ["2023-12-31 23:58", "2024-01-01 00:01"])
    assert [(g.gap_start_utc, g.gap_end_utc) for g in gaps(frame, quality.Audit("1min", "2024-01-02"))] == [(datetime(2023, 12, 31, 23, 59), datetime(2024, 1, 1)), (datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 1))]
    both = frame.unionByName(bars(spark, ["2024-01-01 00:00", "2024-01-01 00:01"], source="z"))
    assert {(r.source, r.day.day, r.n_rows) for r in quality.daily_quality(both, quality.Audit("1min", "2024-01-02")).collect()} == {("s", 31, 1), ("s", 1, 1), ("z", 1, 2)}
