"""Future-return labels at exact times, over complete paths only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.bars import BPS, class_id, price, return_class
from tickloom.operators.segments import with_segments, within_segment
from tickloom.schema import PRICES, SERIES, later

HORIZONS = (3, 6, 9, 12, 15, 30, 60, 180)


def paths(minutes: DataFrame, entries: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """For each entry (series, entry_time_utc, asked: how often) that is a minute bar, and for each horizon: the exit open and what lies between.
    Bars are marked before their frames are made, so only they are exchanged, not eight paths of each. A run has no gap, so `H` rows ahead in a run is `H` minutes ahead; frames that reach past the run's end count too few rows and give null."""
    w = within_segment()
    asked = minutes.select(*SERIES, "timestamp_open_utc", *PRICES).join(entries.withColumnRenamed("entry_time_utc", "timestamp_open_utc"), [*SERIES, "timestamp_open_utc"], "left")
    base = with_segments(asked, 60).withColumn("_r", BPS * (F.log(price("open")) - F.log(F.lag(price("open")).over(w))))
    out = {}
    for h in horizons:
        ahead, after = w.rowsBetween(0, h - 1), w.rowsBetween(1, h)
        out[f"p{h}"] = F.struct(F.lead(price("open"), h).over(w).alias("exit_open"), F.max("bid_high").over(ahead).alias("high"), F.min("bid_low").over(ahead).alias("low"), F.sum(F.col("_r") * F.col("_r")).over(after).alias("variance"))
    wide = base.withColumns(out)
    each = F.array(*[F.struct(F.lit(h).alias("horizon_minutes"), f"p{h}.*") for h in horizons])
    found = wide.filter("asked IS NOT NULL").select(*SERIES, F.col("timestamp_open_utc").alias("entry_time_utc"), price("open").alias("entry_bid_open"), F.inline(F.flatten(F.array_repeat(each, F.col("asked").cast("int")))))
    return found.filter("exit_open IS NOT NULL")


def build_labels(minutes: DataFrame, candidates: DataFrame, horizons: tuple[int, ...] = (15,), latency_minutes: int = 1, threshold_bps: float = 6.0, guard: str | None = None) -> DataFrame:
    """candidates (instrument, source, prediction_time_utc) with entry one latency later and exit one horizon after that.

    Entry and exit must be bars of one run, H bars apart; a path that ends at or after a guard is dropped, but
    only where a caller asks for one (splits.require_before raises instead). Returns, range and realized volatility are in bps; the class is neutral within the threshold, bounds included.
    """
    entries = candidates.select(*SERIES, later(F.col("prediction_time_utc"), latency_minutes).alias("entry_time_utc")).groupBy(*SERIES, "entry_time_utc").agg(F.count("*").alias("asked"))
    found = paths(minutes, entries, horizons).withColumns({"prediction_time_utc": later(F.col("entry_time_utc"), -latency_minutes), "label_end_time_utc": later(F.col("entry_time_utc"), F.col("horizon_minutes"))})
    ratio = F.col("exit_open") / F.col("entry_bid_open")
    future = BPS * (F.log("exit_open") - F.log("entry_bid_open"))
    if guard is not None:
        found = found.filter(F.col("label_end_time_utc") < F.lit(guard).cast("timestamp"))
    return found.select(
        *SERIES, "prediction_time_utc", "entry_time_utc", "label_end_time_utc", "horizon_minutes", "entry_bid_open", F.col("exit_open").alias("exit_bid_open"),
        future.alias("future_return_bps"), (BPS * (ratio - 1)).alias("arithmetic_return_bps"), (BPS * (F.col("high") - F.col("low")) / F.col("entry_bid_open")).alias("future_range_bps"),
        F.sqrt(F.greatest("variance", F.lit(0.0))).alias("future_realized_vol_bps"), return_class(future, threshold_bps).alias("target_class"), class_id(return_class(future, threshold_bps)).alias("target_class_id"),
    )


def labels_by_join(minutes: DataFrame, candidates: DataFrame, horizon: int = 15, latency_minutes: int = 1) -> DataFrame:
    """The same entries and exits found by two equi-joins with the bars and a proof that both lie in one run, H apart."""
    bars = with_segments(minutes, 60, positions=True).select(*SERIES, "timestamp_open_utc", "seg", "seg_pos", "bid_open")
    side = lambda p: bars.withColumnsRenamed({"timestamp_open_utc": f"{p}_time_utc", "seg": f"{p}_seg", "seg_pos": f"{p}_pos", "bid_open": f"{p}_bid_open"})
    asked = candidates.select(*SERIES, "prediction_time_utc").withColumn("entry_time_utc", later(F.col("prediction_time_utc"), latency_minutes)).withColumn("exit_time_utc", later(F.col("prediction_time_utc"), latency_minutes + horizon))
    joined = asked.join(side("entry"), [*SERIES, "entry_time_utc"], "left").join(side("exit"), [*SERIES, "exit_time_utc"], "left")
    return joined.filter((F.col("entry_seg") == F.col("exit_seg")) & (F.col("exit_pos") - F.col("entry_pos") == horizon)).select(*SERIES, "prediction_time_utc", "entry_time_utc", F.col("exit_time_utc").alias("label_end_time_utc"), "entry_bid_open", "exit_bid_open")


def with_sample_ids(rows: DataFrame) -> DataFrame:
    """sample_id for people, and sample_hash over the series, the ISO time and the horizon."""
    t = F.col("prediction_time_utc")
    plain = F.concat_ws("|", "instrument", "source", F.date_format(t, "yyyyMMdd'T'HHmmss.SSSSSS'Z'"))
    parts = F.when(F.unix_micros(t) % 1_000_000 != 0, F.date_format(t, ".SSSSSS")).otherwise("")
    iso = F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), parts, F.lit("+00:00"))
    return rows.withColumn("sample_id", plain).withColumn("sample_hash", F.sha2(F.concat_ws("|", "instrument", "source", iso, F.col("horizon_minutes").cast("string")), 256))
