"""Substring dedup by seed and extend: texts meet on winnowed anchors, matches are extended both ways word by word, and
the words of every repeat of at least the threshold length are removed.

A passage is judged by its windows of `window` words. A window's anchor is its k-gram of smallest hash, leftmost on ties,
so equal windows have equal anchors at equal places and a repeat of the threshold length always shares one (winnowing).
An anchor that occurs once has no repeated window. Where all occurrences of an anchor agree as far as any window around
it reaches, the match extends over all its windows. Only for the others are the windows around the anchor laid out, one
hash for each way to extend, and counted. Runs of repeated windows are the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import REST, ROW, SECOND_ODD, WORD_ODD, Runs, bytes_and_offsets, chunks, mixed, packed, skew_join, unpacked, with_row_id, word_hashes, word_spans


class Winnowed:
    """Words of the texts in an Arrow slice, their windows and the windows' anchors. Word positions count over the slice."""

    def __init__(self, column: pa.Array, window: int, gram: int):
        self.data, offsets = bytes_and_offsets(column)
        self.starts, self.ends, self.first = word_spans(self.data, offsets)
        self.window, self.gram, n = window, gram, len(self.starts)
        self.runs = Runs(word_hashes(self.data, self.starts, self.ends), WORD_ODD)
        self.second = Runs(word_hashes(self.data, self.starts, self.ends, seed=1), SECOND_ODD)
        self.row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.begin = np.arange(max(0, n - window + 1))
        inside = self.row[self.begin] == self.row[self.begin + window - 1] if len(self.begin) else np.zeros(0, dtype=bool)
        at = np.arange(max(0, n - gram + 1))
        self.grams = mixed(self.runs.of(at, at + gram))
        best = sliding_window_view(self.grams, window - gram + 1).argmin(axis=1) if len(self.begin) else np.zeros(0, dtype=np.int64)
        self.begin, self.anchor = self.begin[inside], (self.begin + best)[inside]

    def anchors(self) -> tuple[np.ndarray, ...]:
        """Distinct anchors: position, hash, and hash of all that windows around it can reach within its text."""
        at = self.anchor[np.concatenate([[True], np.diff(self.anchor) > 0])] if len(self.anchor) else self.anchor
        low = np.maximum(self.first[self.row[at]], at - (self.window - self.gram))
        high = np.minimum(self.first[self.row[at] + 1], at + self.window)
        around = self.second.of(low, high) + mixed((at - low).astype(np.uint64) * np.uint64(1 << 32) + (high - at).astype(np.uint64))
        return at, self.grams[at], mixed(around)

    def marked(self, lists: pa.Array) -> np.ndarray:
        """Which word positions the lists, one a text with positions within it, name."""
        out = np.zeros(len(self.starts) + 1, dtype=bool)
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        out[np.repeat(self.first[:-1], counts) + lists.flatten().to_numpy(zero_copy_only=False)] = True
        return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchor_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(row, at, anchor, around) for each distinct anchor of each text; at counts words within the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                w = Winnowed(part.column("text"), window, gram)
                at, anchor, around = w.anchors()
                row = w.row[at]
                yield pa.RecordBatch.from_arrays([part.column(ROW).take(pa.array(row)), pa.array((at - w.first[row]).astype(np.int32)), _signed(anchor), _signed(around)], names=[ROW, "at", "anchor", "around"])

    return docs.select("text", ROW).mapInArrow(run, f"{ROW} long, at int, anchor long, around long")


def window_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(row, begin, anchor, whole) for each window whose anchor is in the text's list `open`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                w = Winnowed(part.column("text"), window, gram)
                asked = w.marked(part.column("open"))[w.anchor]
                begin, anchor = w.begin[asked], w.grams[w.anchor[asked]]
                row = w.row[begin]
                yield pa.RecordBatch.from_arrays([part.column(ROW).take(pa.array(row)), pa.array((begin - w.first[row]).astype(np.int32)), _signed(anchor), _signed(mixed(w.second.of(begin, begin + window)))], names=[ROW, "begin", "anchor", "whole"])

    return docs.mapInArrow(run, f"{ROW} long, begin int, anchor long, whole long")


def cut_repeats(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """docs with kept_text, n_words, n_removed and spans: repeated windows are those of anchors in the list `full` and those
    that begin at a position in `repeated`."""
    rest = [c for c in docs.columns if c not in ("text", "full", "repeated")]
    added = "kept_text string, n_words long, n_removed long, spans array<struct<start:int,end:int>>"
    schema = docs.select(*rest).schema
    from pyspark.sql.types import StructType

    for field in StructType.fromDDL(added):
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                w = Winnowed(part.column("text"), window, gram)
                hit = w.begin[w.marked(part.column("full"))[w.anchor]]
                edge = w.marked(part.column("repeated")).astype(np.int64)
                edge[hit] = 1
                change = np.zeros(len(edge) + window, dtype=np.int64)
                change[: len(edge)] += edge
                change[window : window + len(edge)] -= edge
                gone = np.cumsum(change)[: len(w.starts)] > 0
                raw, texts, removed, spans = w.data.tobytes(), [], [], []
                for a, b in zip(w.first, w.first[1:], strict=False):
                    mine = gone[a:b]
                    removed.append(int(mine.sum()))
                    if not removed[-1]:
                        kept = raw[w.starts[a] : w.ends[b - 1]].split() if b > a else []
                        spans.append([])
                    else:
                        kept = [raw[x:y] for x, y in zip(w.starts[a:b][~mine].tolist(), w.ends[a:b][~mine].tolist(), strict=True)]
                        turn = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
                        spans.append([{"start": int(x), "end": int(y)} for x, y in turn.reshape(-1, 2)])
                    texts.append(b" ".join(kept))
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                columns = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(np.diff(w.first).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, kind)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], *columns], names=[*rest, "kept_text", "n_words", "n_removed", "spans"])

    return docs.mapInArrow(run, schema)


def dedup_substrings(docs: DataFrame, window: int = 50, gram: int = 12) -> DataFrame:
    """All columns of docs with kept_text, n_words, n_removed and spans (removed word ranges): every word is removed that
    a window of `window` words covers whose words also start anywhere else, same text included.

    docs: text and any more columns. Words are [^\\x20\\x09-\\x0D]+, unchanged, over whole texts. All copies of a passage are
    removed, judged on the input. Null and empty texts have no words and an empty kept_text; repeated rows are copies of
    one another; an empty table gives no rows. Two windows count as equal if hashes
    of their anchors and of all their words are, made of XXH64 of the words under two seeds.

    Anchors and windows are counted by partial sums and found again by joins whose hot keys AQE can split, so a passage
    in thousands of texts costs what its occurrences cost. Texts are shuffled once, by row, and that exchange is reused.
    """
    marked = with_row_id(packed(docs, ["text"]).withColumn("text", F.col("text").cast("string")))
    seeds = anchor_rows(marked, window, gram)
    counts = seeds.groupBy("anchor").agg(F.count("*").alias("n"), F.min("around").alias("low"), F.max("around").alias("high")).filter("n > 1").select("anchor", (F.col("low") == F.col("high")).alias("whole_match"))
    met = skew_join(seeds.select(ROW, "at", "anchor"), counts, ["anchor"])
    lists = met.groupBy(ROW).agg(F.collect_list(F.when(F.col("whole_match"), F.col("at"))).alias("full"), F.collect_list(F.when(~F.col("whole_match"), F.col("at"))).alias("open"))
    seeded = marked.join(lists, ROW, "left")  # both uses below take all columns: else their exchanges of texts would differ
    windows = window_rows(seeded.filter(F.size("open") > 0), window, gram)
    repeated = windows.groupBy("anchor", "whole").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "whole")
    begins = skew_join(windows, repeated, ["anchor", "whole"]).groupBy(ROW).agg(F.collect_list("begin").alias("repeated"))
    done = cut_repeats(seeded.join(begins, ROW, "left").select("text", *([REST] if REST in marked.columns else []), "full", "repeated", ROW), window, gram)
    kept = [c for c in docs.columns if c != "text"]
    return unpacked(done, kept, {c: F.col(c) for c in ("kept_text", "n_words", "n_removed", "spans")})
