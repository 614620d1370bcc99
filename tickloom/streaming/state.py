"""Keyed state with event-time timers (transformWithState on the RocksDB store): silence of a series, and the latest fresh row for a row."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.schema import SERIES

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE_US = 60_000_000


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, for the time in which queries are started."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Silence(StatefulProcessor):
    """State: the close of the latest bar, and whether its silence was told. A timer stands at the time from which silence is stale."""

    def __init__(self, stale_us: int):
        self.stale_us = stale_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "close_us long, told boolean")

    def row(self, key: tuple, close_us: int) -> tuple:
        return (*key, close_us, close_us + self.stale_us)

    def told(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=[*SERIES, "silent_from_us", "stale_from_us"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, told = self.last.get() if self.last.exists() else (None, False)
        began, out = last, []
        for opened, closed in sorted((int(a), int(b)) for frame in rows for a, b in zip(frame["open_us"], frame["close_us"], strict=True)):
            if last is not None and not told and opened >= last + self.stale_us:
                out.append(self.row(key, last))
            if last is None or closed > last:
                last, told = closed, False
        if last != began:
            if began is not None:
                self.handle.deleteTimer((began + self.stale_us) // 1000)
            self.handle.registerTimer((last + self.stale_us) // 1000)
            self.last.update((last, told))
        yield from self.told(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, told = self.last.get()
        if not told:
            self.last.update((last, True))
            yield from self.told([self.row(key, last)])

    def close(self) -> None:
        pass


def silences(bars: DataFrame, stale_after_minutes: int, late: str = "10 minutes") -> DataFrame:
    """Each silence of a series once: silent_from_utc, the close of its last bar, and stale_from_utc, stale_after_minutes later. It is
    told when the watermark has passed stale_from_utc, though no row of the series comes any more, or by the bar that ends it.

    Start the query within rocks(). State is one row a series, timers are one a series.
    """
    seen = bars.withWatermark("timestamp_open_utc", late).select(*SERIES, "timestamp_open_utc", F.unix_micros("timestamp_open_utc").alias("open_us"), F.unix_micros("timestamp_close_utc").alias("close_us"))
    found = seen.groupBy(*SERIES).transformWithStateInPandas(Silence(stale_after_minutes * MINUTE_US), "instrument string, source string, silent_from_us long, stale_from_us long", "Append", "EventTime")
    return found.select(*SERIES, F.timestamp_micros("silent_from_us").alias("silent_from_utc"), F.timestamp_micros("stale_from_us").alias("stale_from_utc"))


class Latest(StatefulProcessor):
    """State: the rows that wait for their time, the values that may still be fresh for one, and the one timer, just behind the earliest
    waiting row's time. When it fires, all rows whose time the watermark has passed are answered together: no value of such a time
    or before can come any more."""

    def __init__(self, tolerance_us: int, names: list[str]):
        self.tolerance_us, self.names = tolerance_us, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_us long")
        self.values = handle.getListState("values", "at_us long, " + ", ".join(f"{n} double" for n in self.names))
        self.timer = handle.getValueState("timer", "at_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting, values = [], []
        for frame in rows:
            asked = frame["asked"].astype(bool)
            waiting += [(int(t),) for t in frame["at_us"][asked]]
            values += [(int(t), *[None if pd.isna(x) else float(x) for x in rest]) for t, *rest in frame[~asked][["at_us", *self.names]].itertuples(index=False)]
        if values:
            self.values.appendList(values)
        if waiting:
            self.waiting.appendList(waiting)
            self.wake(min(waiting)[0] // 1000 + 1)
        return iter(())

    def wake(self, at_ms: int) -> None:
        if self.timer.exists():
            if (before := self.timer.get()[0]) <= at_ms:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at_ms)
        self.timer.update((at_ms,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.timer.clear()
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        waiting = sorted(t for (t,) in self.waiting.get()) if self.waiting.exists() else []
        values = sorted(self.values.get(), key=lambda v: v[0]) if self.values.exists() else []
        due = [t for t in waiting if t < passed]
        stay = waiting[len(due) :]
        oldest = min([passed, *stay[:1]]) - self.tolerance_us
        for state, kept in ((self.waiting, [(t,) for t in stay]), (self.values, [v for v in values if v[0] >= oldest])):
            state.put(kept) if kept else state.clear()
        if stay:
            self.wake(stay[0] // 1000 + 1)
        times, out = [v[0] for v in values], []
        for t in due:
            k = bisect_right(times, t) - 1
            fresh = k >= 0 and times[k] >= t - self.tolerance_us
            out.append((*key, t, *(values[k] if fresh else (None,) * (1 + len(self.names)))))
        if out:
            frame = pd.DataFrame(out, columns=[*SERIES, "at_us", "found_us", *self.names])
            yield frame.astype({"at_us": "int64", "found_us": "Int64", **dict.fromkeys(self.names, "float64")})

    def close(self) -> None:
        pass


def latest_fresh(left: DataFrame, right: DataFrame, tolerance_minutes: int, names: list[str], late: str = "10 minutes") -> DataFrame:
    """Each left row (series, prediction_time_utc) once, when the watermark has passed its time, with the latest right row (available_at_utc and the
    named numbers) at most tolerance_minutes old, nulls where there is none: the batch as-of join, row by row.

    Start the query within rocks(). A series holds the rows between the watermark and its latest time, and values no older than the tolerance.
    """
    none = [F.lit(None).cast("double").alias(n) for n in names]
    asked = left.select(*SERIES, F.col("prediction_time_utc").alias("at_utc"), F.lit(True).alias("asked"), *none)
    told = right.select(*SERIES, F.col("available_at_utc").alias("at_utc"), F.lit(False).alias("asked"), *[F.col(n).cast("double").alias(n) for n in names])
    both = asked.unionByName(told).withWatermark("at_utc", late).withColumn("at_us", F.unix_micros("at_utc"))
    schema = "instrument string, source string, at_us long, found_us long, " + ", ".join(f"{n} double" for n in names)
    found = both.groupBy(*SERIES).transformWithStateInPandas(Latest(tolerance_minutes * MINUTE_US, names), schema, "Append", "EventTime")
    return found.select(*SERIES, F.timestamp_micros("at_us").alias("prediction_time_utc"), F.timestamp_micros("found_us").alias("available_at_utc"), *names)
