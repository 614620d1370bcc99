"""Market calendars as small tables, and gap slots classified against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.schema import SERIES, later, seconds, window_end


def weekly_windows(spark: SparkSession, rows: list[tuple[int, int, int]]) -> DataFrame:
    """(weekday from Monday, first minute, end minute) of the open hours of a week: at most some dozens of rows."""
    return spark.createDataFrame(rows, "weekday int, start_minute int, end_minute int")


def exceptions(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """(holiday or maintenance, start, end) in UTC, half open."""
    return spark.createDataFrame(rows, "kind string, start string, end string").selectExpr("kind", "CAST(start AS TIMESTAMP) AS start_utc", "CAST(end AS TIMESTAMP) AS end_utc")


def states(slots: DataFrame, weekly: DataFrame, special: DataFrame, time: str = "timestamp_open_utc", weekend: tuple[int, ...] = (5, 6)) -> DataFrame:
    """slots with market_status: maintenance, then holiday, then weekend (weekdays from Monday 0; open hours on them don't
    count), then the week's open hours, else unknown.

    Calendars are a fixed number of rows, given by hand, so they are broadcast; a slot meets few of them.
    """
    t = F.col(time)
    minute = F.hour(t) * 60 + F.minute(t)
    hours = F.broadcast(weekly.groupBy("weekday").agg(F.collect_list(F.struct("start_minute", "end_minute")).alias("_hours")))
    out = slots.withColumn("_wd", F.weekday(t)).join(hours, F.col("_wd") == F.col("weekday"), "left").drop("weekday")
    days = F.broadcast(special.select("kind", "start_utc", "end_utc", F.explode(F.sequence(F.to_date("start_utc"), F.to_date("end_utc"))).alias("_d")).groupBy("_d").agg(F.collect_list(F.struct("kind", "start_utc", "end_utc")).alias("_special")))
    out = out.withColumn("_date", F.to_date(t)).join(days, F.col("_date") == F.col("_d"), "left")
    inside = lambda kind: F.coalesce(F.exists("_special", lambda x: (x["kind"] == kind) & (t >= x["start_utc"]) & (t < x["end_utc"])), F.lit(False))
    is_open = F.coalesce(F.exists("_hours", lambda x: (minute >= x["start_minute"]) & (minute < x["end_minute"])), F.lit(False))
    status = F.when(inside("maintenance"), "maintenance").when(inside("holiday"), "holiday").when(F.col("_wd").isin(*weekend), "weekend").when(is_open, "open").otherwise("unknown")
    return out.withColumn("market_status", status).drop("_wd", "_hours", "_date", "_d", "_special")


def interval_states(slots: DataFrame, weekly: DataFrame, special: DataFrame, timeframe: str) -> DataFrame:
    """(timestamp_open_utc, market_status, expected) for each slot: intraday bars are expected if all their minutes are open, days and months
    if any is. Bars not expected have the status that all their minutes share, else unknown."""
    t = F.col("timestamp_open_utc")
    if timeframe == "1min":
        return states(slots.select(t), weekly, special).withColumn("expected", F.col("market_status") == "open")
    minutes = slots.select(t, F.explode(F.sequence(t, later(window_end(t, timeframe), -1), F.expr("INTERVAL 1 MINUTE"))).alias("_m"))
    is_open = F.col("market_status") == "open"
    grouped = states(minutes, weekly, special, "_m").groupBy("timestamp_open_utc").agg((F.bool_or(is_open) if timeframe in ("1d", "1mo") else F.bool_and(is_open)).alias("expected"), F.min("market_status").alias("_low"), F.max("market_status").alias("_high"))
    status = F.when(F.col("expected"), "open").when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise("unknown")
    return grouped.select("timestamp_open_utc", status.alias("market_status"), "expected")


def interval_expected(slots: DataFrame, weekly: DataFrame, special: DataFrame, timeframe: str) -> DataFrame:
    """interval_states for the slots of series."""
    return slots.select(*SERIES, "timestamp_open_utc").join(interval_states(slots.select("timestamp_open_utc").distinct(), weekly, special, timeframe), "timestamp_open_utc")


def expected_grid(bars: DataFrame, timeframe: str) -> DataFrame:
    """The slots of each series from its first bar to its last, days without a bar included, a day at a time."""
    step = F.expr(f"INTERVAL {seconds(timeframe)} SECONDS")
    spans = bars.groupBy(*SERIES).agg(F.min("timestamp_open_utc").alias("a"), F.max("timestamp_open_utc").alias("b"))
    days = spans.select(*SERIES, "a", "b", F.explode(F.sequence(F.to_date("a"), F.to_date("b"))).alias("day"))
    start = F.col("day").cast("timestamp")
    return days.select(*SERIES, "day", F.explode(F.filter(F.sequence(start, later(start, 1440) - step, step), lambda s: s.between(F.col("a"), F.col("b")))).alias("timestamp_open_utc"))


def missing_slots(bars: DataFrame, timeframe: str) -> DataFrame:
    return expected_grid(bars, timeframe).join(bars.select(*SERIES, "timestamp_open_utc"), [*SERIES, "timestamp_open_utc"], "left_anti")


def classify_gaps(slots: DataFrame, known: DataFrame, weekly: DataFrame | None = None, special: DataFrame | None = None) -> DataFrame:
    """slots with classification: the first known gap that holds it (its reason), else scheduled_closure where the calendar is
    not open, else missing_data; without a calendar, unknown_market_status.

    known: place, start_utc, end_utc, reason, and instrument and source, where null stands for any; a list kept by hand.
    """
    entry = F.struct("place", "reason", "start_utc", "end_utc", "instrument", "source")
    days = known.select(entry.alias("_gap"), F.explode(F.sequence(F.to_date("start_utc"), F.to_date("end_utc"))).alias("_d"))
    t, fits = F.col("timestamp_open_utc"), lambda own, asked: asked.isNull() | (asked == F.col(own))
    holds = lambda g: (t >= g["start_utc"]) & (t < g["end_utc"]) & fits("instrument", g["instrument"]) & fits("source", g["source"])
    listed = days.groupBy("_d").agg(F.collect_list("_gap").alias("_gaps"))
    first = slots.withColumn("_date", F.to_date(t)).join(listed, F.col("_date") == F.col("_d"), "left").withColumn("known_reason", F.array_min(F.filter("_gaps", holds))["reason"]).drop("_date", "_d", "_gaps")
    if weekly is None:
        return first.withColumn("classification", F.when(F.col("known_reason").isNotNull(), "known_gap").otherwise("unknown_market_status"))
    status = states(first, weekly, special)
    return status.withColumn("classification", F.when(F.col("known_reason").isNotNull(), "known_gap").when(F.col("market_status") != "open", "scheduled_closure").otherwise("missing_data"))


def gap_islands(slots: DataFrame, timeframe: str) -> DataFrame:
    """Runs of adjacent slots of one day with equal classification, as start, end and number of slots."""
    w = Window.partitionBy(*SERIES, "day").orderBy("timestamp_open_utc")
    t = F.unix_seconds("timestamp_open_utc")
    new = (t - F.lag(t).over(w) != seconds(timeframe)) | (F.lag("classification").over(w) != F.col("classification"))
    marked = slots.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("_id", F.sum("_new").over(w))
    return marked.groupBy(*SERIES, "day", "_id", "classification").agg(F.min("timestamp_open_utc").alias("gap_start_utc"), later(F.max("timestamp_open_utc"), seconds(timeframe) // 60).alias("gap_end_utc"), F.count("*").alias("n_slots")).drop("_id")


def coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("timeframe").agg(F.count("*").alias("n_rows"), F.min("timestamp_open_utc").alias("first_open_utc"), F.max("timestamp_close_utc").alias("last_close_utc"))
