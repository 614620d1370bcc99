"""Bars replayed as a stream of files, and the online row: the batch plan run on what is known, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.schema import SERIES, later
from tickloom.scratch import new_path
from tickloom.streaming.bars import run_available
from tickloom.streaming.state import rocks


FILE_ROWS = 250_000


def replay_files(rows: DataFrame, time: str, parts: int, file_rows: int = FILE_ROWS) -> tuple[str, int]:
    """rows as `parts` equal spans of time, one written after the other, as a feed would leave them. The path, and how many files each span
    has, so that a trigger can take up a span: about file_rows rows a file, for no task should write or read a whole span.

    rows are read twice, so they should be a table of files: for the ends of time, and to lie by span in a table of their own, from which
    the spans are written in order."""
    spark = rows.sparkSession
    path, staged = new_path(spark), new_path(spark)
    low, high, n = rows.agg(F.min(F.unix_seconds(time)), F.max(F.unix_seconds(time)), F.count("*")).first()
    none = rows.limit(0).coalesce(1)
    if low is None:
        none.write.parquet(path)
        return path, 1
    files = max(1, -(-n // (parts * file_rows)))
    span = F.floor(((F.unix_seconds(time) - low + 1) * parts - 1) / (high + 1 - low)).cast("int")  # ends of spans are rounded down
    rows.withColumn("_span", span).filter("_span IS NOT NULL").write.partitionBy("_span").parquet(staged)
    known = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_span", T.IntegerType())])).parquet(staged)
    for k in range(parts):
        part = known.filter(F.col("_span") == k).drop("_span")
        (part.repartitionByRange(files, time) if files > 1 else part.coalesce(1)).write.mode("append").parquet(path)
        for _ in range((k + 1) * files - _data_files(spark, path)):  # a span of few times
            none.write.mode("append").parquet(path)
    return path, files


def _data_files(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return sum(f.getPath().getName().startswith("part-") for f in found)


def streamed(rows: DataFrame, time: str, parts: int, file_rows: int = FILE_ROWS) -> DataFrame:
    """rows as a stream, a span of replay_files at a time."""
    path, files = replay_files(rows, time, parts, file_rows)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def outcome(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream over the files there emits, as a table."""
    path = new_path(spark)
    with rocks(spark):
        run_available(stream, path, new_path(spark), mode)
    return spark.read.schema(stream.schema).parquet(path)


def online_rows(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], lookback_minutes: int) -> DataFrame:
    """For each micro-batch of bars the row of each series that the batch plan gives at the last known close: the plan (bars to rows with
    prediction_time_utc) sees only bars closed by then and opened within the lookback. Each batch's bars and rows have a folder of its own, written
    anew if the batch is run again, so a restart leaves no row twice."""
    spark = stream.sparkSession
    seen, out = new_path(spark), new_path(spark)

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{seen}/batch={number}")
        cutoff = batch.sparkSession.read.schema(batch.schema).parquet(f"{seen}/batch={number}").agg(F.max("timestamp_close_utc").alias("_cutoff"))
        bars = batch.sparkSession.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(seen).join(F.broadcast(cutoff))  # one row
        known = bars.filter((F.col("timestamp_close_utc") <= F.col("_cutoff")) & (F.col("timestamp_open_utc") >= later(F.col("_cutoff"), -lookback_minutes))).drop("_cutoff")
        rows = plan(known)
        others = [c for c in rows.columns if c not in SERIES]
        last = rows.groupBy(*SERIES).agg(F.max_by(F.struct(*others), "prediction_time_utc").alias("row")).select(*SERIES, "row.*")
        last.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.option("checkpointLocation", new_path(spark)).trigger(availableNow=True).foreachBatch(step).start()
    query.awaitTermination()
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*")
