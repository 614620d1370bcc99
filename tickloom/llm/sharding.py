"""Sharding by minimax contiguous partition: ordered atomic groups are cut into runs whose largest is as small as can be."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import before, materialize, shuffle_partitions, skew_join

FAN = 64


def smallest_capacity(ends: DataFrame, shards: int) -> list[int]:
    """Cut points of the minimax partition. ends: one row a group, end = sum of sizes up to and with the group.

    A capacity is feasible if greedy filling needs at most `shards` runs. FAN capacities are tried together, so a round
    takes six steps of the binary search; a pass over the table finds how far the next run of each can reach, and a
    round is `shards` passes. The driver holds FAN numbers at a time, however many groups there are.
    """
    total, largest = ends.agg(F.max("end"), F.max("size")).first()
    if not total:
        return [0] * shards

    def greedy(capacities: list[int]) -> list[list[int]]:
        cuts: list[list[int]] = [[] for _ in capacities]
        for _ in range(shards):
            reach = [(c[-1] if c else 0) + most for c, most in zip(cuts, capacities, strict=True)]  # ascending, as capacities are
            passed = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in reach]), lambda x: x < F.col("end"))).alias("passed")
            within = ends.select("end", passed).agg(*[F.max(F.when(F.col("passed") == i, F.col("end"))) for i in range(len(reach))]).first()
            far = 0
            for mine, end in zip(cuts, within, strict=True):
                far = max(far, end or 0)
                mine.append(far)
        return cuts

    low, high, best = max(largest, -(-total // shards)), largest + -(-total // shards), None  # high always suffices
    while best is None or low < high:
        step = max(1, -(-(high - low) // FAN))
        tried = sorted({*range(low, high, step), high})
        cuts = greedy(tried)
        good = next(i for i, c in enumerate(cuts) if c[-1] >= total)
        best, high = cuts[good], tried[good]
        low = tried[good - 1] + 1 if good else high
    return best


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Put every row into one of `shards` shards; equal texts stay together, shards are near equal in bytes.

    docs: doc_id, text; other columns aren't used. Size: UTF-8 bytes of the text plus 1 (null text: as empty). Groups of
    equal texts stand in the order of their smallest doc_id (null first) and are cut into contiguous runs, the largest
    as small as possible. Returns doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard, in that order).
    Fewer groups than shards leave shards empty; an empty table gives no rows. Texts are told apart by two 64-bit
    hashes; only ids, sizes and hashes are shuffled. A group of any size is never gathered: rows are ordered by range
    over (group, doc_id), and a group may span partitions.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    groups = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    order = [F.col(c) for c in ("first", "h1", "h2", "doc_id")]
    ranged = skew_join(rows, groups, ["h1", "h2"]).repartitionByRange(shuffle_partitions(docs.sparkSession), *order)
    placed = materialize(ranged.withColumn("pid", F.spark_partition_id()))
    earlier = F.broadcast(before(placed, {"bytes_before": F.col("size"), "rows_before": F.lit(1)}))
    run = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.select("*", F.sum("size").over(run).alias("run_bytes"), F.row_number().over(run.orderBy(*order)).alias("run_rows")).join(earlier, "pid")
    running = materialize(running.select("doc_id", "size", "text_crc32", "h1", "h2", (F.col("bytes_before") + F.col("run_bytes")).alias("end"), (F.col("rows_before") + F.col("run_rows")).alias("row")))
    ends = materialize(running.groupBy("h1", "h2").agg(F.max("end").alias("end"), F.sum("size").alias("size")).select("end", "size"))
    cuts = smallest_capacity(ends, shards)[:-1]
    rows_to = running.agg(*[F.coalesce(F.max(F.when(F.col("end") <= F.lit(c), F.col("row"))), F.lit(0)).alias(f"c{i}") for i, c in enumerate(cuts)], F.lit(0).alias("none")).first()
    shard = sum([(F.col("end") > F.lit(c)).cast("int") for c in cuts], F.lit(0))
    starts = F.array(F.lit(0).cast("long"), *[F.lit(r).cast("long") for r in rows_to[:-1]])
    return running.select("doc_id", "size", "text_crc32", shard.alias("shard"), "row").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - 1 - starts[F.col("shard")]).alias("slot"))
