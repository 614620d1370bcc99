"""Sharded vector search: shards of indexed rows, each met by all queries, a shard and a block of queries at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import ROW, shuffle_partitions

QUERY_BLOCK, BLOCK_QUERIES = 512, 100_000
NO_ID = -(1 << 63)  # stands for a null vec_id within tasks: it sorts first, as nulls do


def finite(vector: str) -> Column:
    """Vectors that are not null and hold no null, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def search(rows: DataFrame, queries: DataFrame, k: int, shard_rows: int, build: Callable, look: Callable, score_type: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query, a query's own row left out, ties to smaller vec_id.

    rows, queries: _row, vec_id, vec (array<double> without nulls). Rows are dealt by a hash of their row id to shards of
    about shard_rows, and queries to blocks of about BLOCK_QUERIES; each block meets every shard of its dimension. A
    task sorts a shard's rows before a block's queries, builds one index (build: ids, row ids, matrix) and streams
    QUERY_BLOCK queries at a time through it (look: index, row ids, matrix, k; gives query index, vec_id, row id, score, and
    whether the score left its type). A shard's k best are then ranked; a score among them that left its type is an error.
    """
    sizes = rows.count(), queries.count()
    shards, blocks = (max(1, -(-n // most)) for n, most in zip(sizes, (shard_rows, BLOCK_QUERIES), strict=True))
    cols = [ROW, "vec_id", "vec", F.size("vec").alias("dim")]
    dealt = lambda parts: F.pmod(F.xxhash64(ROW), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    index = rows.select(*cols, dealt(shards).alias("shard"), each(blocks).alias("block"), F.lit(0).alias("kind"))
    asked = queries.select(*cols, dealt(blocks).alias("block"), each(shards).alias("shard"), F.lit(1).alias("kind"))
    place = ["dim", "shard", "block"]
    both = index.unionByName(asked).repartition(shuffle_partitions(rows.sparkSession), *place).sortWithinPartitions(*place, "kind", ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, built = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            row, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in (ROW, "kind"))
            ids = batch.column("vec_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            where = list(zip(*[batch.column(c).to_pylist() for c in place], kind.tolist(), strict=True))
            flat, offsets = batch.column("vec").flatten().to_numpy(zero_copy_only=False), batch.column("vec").offsets.to_numpy()
            offsets = offsets - offsets[0]
            cuts = [0, *[i for i in range(1, len(where)) if where[i] != where[i - 1]], len(where)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                *group, mine = where[a]
                if at != group:
                    at, held, built = group, [], None
                matrix = flat[offsets[a] : offsets[b]].reshape(b - a, group[0])
                if not mine:
                    held.append((ids[a:b], row[a:b], matrix))
                elif held:
                    if built is None:
                        built = build(*[np.concatenate(x) for x in zip(*held, strict=True)])
                    for c in range(0, b - a, QUERY_BLOCK):
                        part = slice(a + c, min(b, a + c + QUERY_BLOCK))
                        q, vec, of, score, over = look(built, row[part], matrix[c : c + QUERY_BLOCK], k)
                        yield pa.RecordBatch.from_arrays([pa.array(row[part][q]), pa.array(ids[part][q]), *map(pa.array, (vec, of, score, over))], names=["q_row", "query_id", "vec_id", "of", "score", "over"])

    found = both.select(ROW, "vec_id", "vec", *place, "kind").mapInArrow(run, f"q_row long, query_id long, vec_id long, of long, score {score_type}, over boolean")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q_row").orderBy(F.col("score").desc(), "vec_id", "of"))).filter(F.col("rank") <= k)
    null_id = lambda c: F.when(F.col(c) != F.lit(NO_ID), F.col(c)).alias(c)
    fits = F.when(~F.col("over"), F.col("score")).otherwise(F.raise_error(F.lit(f"a score does not fit {score_type}")))
    return ranked.select(null_id("query_id"), "rank", null_id("vec_id"), fits.alias("score"))


def power_above(x: np.ndarray) -> int:
    """The least n such that all magnitudes are at most 2**n; 0 where all are zero."""
    most = float(np.abs(x).max(initial=0.0))
    return int(np.frexp(most)[1]) if most else 0


class Best:
    """The k best (score, then smaller id, then smaller row id) of every query in a block so far. Scores are doubles, or Python
    integers of any size."""

    def __init__(self, queries: int, k: int, dtype):
        self.k, self.dtype = k, dtype
        self.score = [np.zeros(0, dtype=dtype) for _ in range(queries)]
        self.id = [np.zeros(0, dtype=np.int64) for _ in range(queries)]
        self.row = [np.zeros(0, dtype=np.int64) for _ in range(queries)]
        self.least = [None] * queries  # the k-th best score, once there are k

    def add(self, q: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: int) -> None:
        near = rows != own
        if self.least[q] is not None:
            near &= (score >= self.least[q]).astype(bool)
        if not near.any():
            return
        s, i, r = (np.concatenate(x) for x in ((self.score[q], score[near]), (self.id[q], ids[near]), (self.row[q], rows[near])))
        if s.dtype == object:
            order = np.array(sorted(range(len(s)), key=lambda j: (-int(s[j]), i[j], r[j]))[: self.k])
        else:
            order = np.lexsort((r, i, ~s if s.dtype == np.int64 else -s))[: self.k]
        self.score[q], self.id[q], self.row[q] = s[order], i[order], r[order]
        if len(order) == self.k:
            self.least[q] = s[order[-1]]

    def rows(self) -> tuple[np.ndarray, ...]:
        q = np.repeat(np.arange(len(self.score)), [len(x) for x in self.score])
        score = np.concatenate(self.score)
        over = np.zeros(len(score), dtype=bool)
        if self.dtype != np.float64:
            low, high = -(1 << 63), (1 << 63) - 1
            over = np.array([not low <= int(x) <= high for x in score], dtype=bool)
            score = np.array([min(max(int(x), low), high) for x in score], dtype=np.int64)
        return q, np.concatenate(self.id), np.concatenate(self.row), score, over
