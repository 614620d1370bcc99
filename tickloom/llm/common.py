"""What the corpus operators share: scratch tables, skew-safe keys, global order, word hashes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "_row"


def scratch_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine stands in on a
    local master only; on a cluster that is an error, for executors would not see one another's files."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file:///tmp/checkpoints/tickloom"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/scratch-{spark.sparkContext.applicationId}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the time of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor loses none of it.
    The shuffle files of the job that wrote it go at once."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no later plan reads."""
    for table in tables:
        remove(table.sparkSession, table.scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that the operators of this application left in the shared folder; results not yet written are lost."""
    remove(spark, scratch_root(spark))


def numbered(df: DataFrame) -> DataFrame:
    """A long id per row, good for one use of the frame: repeated rows and null ids stay apart."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def plain_scan(df: DataFrame) -> bool:
    """Whether df is columns and filters of one table of files, so that each evaluation meets the same rows in one order."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter") and plan.deterministic():
        plan = plan.child()
    return plan.nodeName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation"


def stable(df: DataFrame) -> DataFrame:
    """df, written once unless it is a plain scan: what is numbered again is then numbered alike."""
    return df if plain_scan(df) else materialize(df)


def with_row_id(df: DataFrame) -> DataFrame:
    """A long id per row, the same however often the frame is evaluated. Scans of files are numbered as they are split, and
    the split is held fixed should executors come or go; any other frame is written once, with its ids."""
    spark = df.sparkSession
    if not plain_scan(df):
        return materialize(numbered(df))
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return numbered(df)


REST = "_rest"


def packed(docs: DataFrame, needed: list[str]) -> DataFrame:
    """The needed columns and, as one struct, all others, whose names then cannot clash with an operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, *([F.struct(*rest).alias(REST)] if rest else []))


def unpacked(df: DataFrame, columns: list[str], added: dict[str, Column], changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns that went into packed(), some changed, then the added ones, which replace columns of their names."""
    changed = changed or {}
    own = [changed[c].alias(c) if c in changed else F.col(c) if c in df.columns and c != REST else F.col(REST)[c].alias(c) for c in columns if c not in added]
    return df.select(*own, *[v.alias(k) for k, v in added.items()])


def rekeyed(key: str) -> Column:
    """A long key as a new expression. A join on it always exchanges both sides by itself, also where one comes out of a
    grouping on the key; only such exchanges can AQE split when one key holds many rows."""
    return F.col(key).bitwiseXOR(F.lit(0).cast("long"))


def skew_join(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join many rows a key with at most one row a key (long keys); hot keys are split by AQE. Keeps many's key columns."""
    marks = [f"_k{i}" for i in range(len(keys))]
    side = lambda df: df.withColumns({m: rekeyed(k) for m, k in zip(marks, keys, strict=True)}).drop(*keys)
    return side(many).join(side(few), marks, how).withColumnsRenamed(dict(zip(marks, keys, strict=True)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """Add pid and idx: idx numbers all rows from 0 in the given order. Range partitions, sorted one by one; only their
    row counts (a row a partition) meet in one place. The order should tell rows apart, or equal rows come in any order."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("pid", F.shiftright("_at", 33).cast("int")).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return placed.join(F.broadcast(before(placed, {"_n": F.lit(1)})), "pid").withColumn("idx", F.col("_at") + F.col("_n")).drop("_at", "_n")


def before(placed: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Per pid the sums over all earlier pids: as many rows as there are partitions."""
    from pyspark.sql import Window

    w = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    per = placed.groupBy("pid").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    return per.select("pid", *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in sums])


# Word hashing over whole Arrow batches. A hash of a run is (C[end] - C[start]) * P**-start with C the running sum of value * P**i.

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
CHUNK_BYTES = 2_000_000


def bytes_and_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a string column in a row, and where each begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in slices of about CHUNK_BYTES of text, at least one row each: bounds what numpy holds at once."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words [^\\x20\\x09-\\x0D]+, and per document the index of its first word (one entry more)."""
    inside = ~SEPARATOR[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    starts[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bit mixer for 64-bit words: multiply and shift, so that all bits depend on all."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Runs:
    """Hashes of runs of values in one array, each in constant time. odd: the multiplier, any odd number."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, odd: int):
        n = len(values) + 1
        if odd not in self._powers or len(self._powers[odd][0]) < n:
            size = max(n, 1 << 16)
            full = lambda x: np.full(size, x, dtype=np.uint64)
            up, down = full(odd), full(pow(odd, -1, 1 << 64))
            up[0] = down[0] = 1
            self._powers[odd] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        up, self.down = self._powers[odd]
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(values.astype(np.uint64) * up[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


WORD_ODD, SECOND_ODD = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
# The five primes of XXH64.
PRIMES = tuple(map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)))


def rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of each word: those under 32 bytes all together, lane by lane, longer ones each by the library."""
    p1, p2, p3, p4, p5 = PRIMES
    left, at = ends - starts, starts.astype(np.int64)
    out = np.uint64(seed) + p5 + left.astype(np.uint64)
    long = np.flatnonzero(left >= 32)
    left = np.where(left < 32, left, 0)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    lanes = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for width, rounds in ((8, 3), (4, 1), (1, 3)):
        for _ in range(rounds):
            these = np.flatnonzero(left >= width)
            if not len(these):
                break
            where, h = at[these], out[these]
            if width == 8:
                lane = rotated(lanes[where].view("<u8")[:, 0] * p2, 31) * p1
                out[these] = rotated(h ^ lane, 27) * p1 + p4
            elif width == 4:
                out[these] = rotated(h ^ lanes[where, :4].view("<u4")[:, 0].astype(np.uint64) * p1, 23) * p2 + p3
            else:
                out[these] = rotated(h ^ padded[where].astype(np.uint64) * p5, 11) * p1
            at[these] += width
            left[these] -= width
    out = (out ^ (out >> np.uint64(33))) * p2
    out = (out ^ (out >> np.uint64(29))) * p3
    out ^= out >> np.uint64(32)
    for i in long.tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return out
