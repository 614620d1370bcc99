"""Packing documents into token sequences by best-two-fit.

Piece lengths lie between 1 and the sequence length, so the packing problem is a histogram of that many counts, whatever
the corpus size. It is solved on the histogram; Spark numbers the pieces of each length and a range join deals them out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import global_order, materialize

PIECES = "doc_id long, piece int, start long, length long, ids binary"
_coders: dict = {}


def coder(tokenizer: str, ranks: str | None):
    """Text to uint32 ids as the tokenizer file gives them. ranks: the same vocabulary as byte ranks, coded several times
    faster; texts with one of the tokenizer's added tokens go the plain way."""
    if (tokenizer, ranks) in _coders:
        return _coders[tokenizer, ranks]
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    slow = lambda text: np.array(plain.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    code = slow
    if ranks:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        added = [t["content"] for t in json.loads(plain.to_str())["added_tokens"]]
        code = lambda text: slow(text) if any(a in text for a in added) else fast.encode_to_numpy(text, disallowed_special=())
    _coders[tokenizer, ranks] = code
    return code


def tokenize_pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids (little-endian uint32). Each document's ids end with end_id.

    Only documents of over `capacity` ids are cut, into full pieces but for the first. Null text: the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer, ranks)
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(code(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                for i, a in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[a : first if not i else a + capacity]
                    out.append((doc.as_py(), i, a, len(part), part.tobytes()))
                held += ids.nbytes
                if held > 4_000_000:
                    yield _pieces(out)
                    out, held = [], 0
            if out:
                yield _pieces(out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=pa.schema(kinds))


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Bins for counts[l] pieces of each length l, as (lengths in a bin, number of such bins).

    A bin opens with the longest piece left and takes the longest that fits, again and again. Then its smallest piece
    but the first is replaced by the two unpacked lengths that fill the widened gap best, if they beat it. The bin is
    repeated as often as its lengths last, so there are a few bins a length at most, however many pieces.
    """
    left, bins = counts.astype(np.int64).copy(), []
    while left.any():
        free, lengths, room = left.copy(), [], capacity
        while room > 0 and (fits := np.flatnonzero(free[: room + 1])).size:
            lengths.append(int(fits[-1]))
            free[fits[-1]] -= 1
            room -= lengths[-1]
        if room and len(lengths) > 1:
            smallest = lengths[-1]
            gap = room + smallest
            have = np.flatnonzero(free[:gap])
            best, pair = smallest, None
            for x in have.tolist():
                rest = have[(have <= gap - x) & ((have != x) | (free[have] > 1))]
                if rest.size and x + int(rest[-1]) > best:
                    best, pair = x + int(rest[-1]), [x, int(rest[-1])]
            if pair:
                lengths[-1:] = sorted(pair, reverse=True)
        used = np.bincount(lengths, minlength=len(left))
        times = int((left[used > 0] // used[used > 0]).min())
        left -= times * used
        bins.append((lengths, times))
    return bins


def place_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length and any more columns): every sequence holds at most
    `capacity` tokens, offsets are gapless from 0. Rows of equal length are dealt out in the order of doc_id, piece.

    The histogram (at most `capacity` rows) is all that reaches the driver, and the table of runs that is broadcast has
    a row for each length in each kind of bin, its size bounded by `capacity` too.
    """
    spark = pieces.sparkSession
    placed = global_order(pieces, [F.col("length"), F.col("doc_id"), F.col("piece")])
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in placed.groupBy("length").count().collect():
        counts[length] = n
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    taken, runs, sequence = np.zeros(capacity + 1, dtype=np.int64), [], 0
    for lengths, times in best_two_fit(counts, capacity):
        offset = 0
        for x in lengths:
            begin = int(first[x] + taken[x])
            runs.append({"begin": begin, "until": begin + times, "sequence": sequence, "at": offset, "len": x})
            taken[x] += times
            offset += x
        sequence += times
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(runs)), "array<struct<begin:long,until:long,sequence:long,at:long,len:long>>")))
    joined = placed.join(F.broadcast(table), (F.col("length") == F.col("len")) & (F.col("idx") >= F.col("begin")) & (F.col("idx") < F.col("until")))
    return joined.withColumn("sequence_id", F.col("sequence") + F.col("idx") - F.col("begin")).withColumn("offset", F.col("at")).drop("pid", "idx", *[c for c in ("begin", "until", "sequence", "at", "len")])


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 1024, end_id: int = 2, keep_ids: bool = True) -> DataFrame:
    """Documents to packed sequences: a row a piece with doc_id, piece, start, length, ids_crc32, sequence_id, offset, and
    ids if asked for. Empty texts are one end id; an empty table gives no rows; null and repeated doc_ids are kept."""
    pieces = tokenize_pieces(docs, tokenizer, ranks, capacity, end_id).withColumn("ids_crc32", F.crc32("ids"))
    return place_pieces(materialize(pieces if keep_ids else pieces.drop("ids")), capacity)  # ordering reads its input twice
