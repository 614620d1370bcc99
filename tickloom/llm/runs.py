"""Periodic runs of words in linear time by Lyndon arrays over an ordered alphabet, after Ellert and Fischer.

A run is a stretch of words with smallest period q that no neighbouring word extends and that is at least 2 q long. In one of two
orders of the alphabet, the word order and its reverse, each run has a root that is a Lyndon word: the next smaller suffix of the
root's first word begins right behind it. So the Lyndon arrays of both orders name all candidates.
Suffixes are compared only between a word and the ones on its chain of smaller predecessors. How far two suffixes match is taken
from the matches already made wherever it can be: from the neighbour on the chain where their lengths differ, from the copy where
both suffixes lie in a stretch that was found to repeat an earlier one; words are compared only beyond the furthest match. No
suffix array, no fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.llm.common import REST, packed, unpacked

RUNS = "array<struct<start:long,length:long,period:long>>"
WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 10


def lyndon_array(letters: list[int], tally: list[int] | None = None) -> tuple[list[int], list[int]]:
    """For each place the next one whose suffix is smaller (their number if none) and how many letters both suffixes share.
    An end is smaller than any letter. tally: one number, raised by the letters compared."""
    n, w, compared = len(letters), [*letters, min(letters, default=0) - 1], 0
    after, shared_after, before, shared_before = [n] * n, [0] * n, [-1] * n, [0] * n
    shift = copy = reach = 0  # the suffix at copy repeats the one `shift` earlier up to reach
    for i in range(1, n):
        j, shared, told = i - 1, 0, False
        while j >= 0:
            if not told:
                if i < reach and j >= copy:
                    x, y = j - shift, i - shift
                    if after[x] == y:
                        shared, told = shared_after[x], True
                    elif before[y] == x:
                        shared, told = shared_before[y], True
                    if told and i + shared >= reach:
                        shared, told = reach - i, False
                if not told:
                    start = shared
                    while w[j + shared] == w[i + shared]:
                        shared += 1
                    compared += shared - start + 1
                    if i + shared > reach:
                        shift, copy, reach = i - j, i, i + shared
            if w[j + shared] < w[i + shared]:
                before[i], shared_before[i] = j, shared
                break
            after[j], shared_after[j] = i, shared
            known, j = shared_before[j], before[j]
            told = known != shared
            shared = min(known, shared)
    if tally is not None:
        tally[0] += compared
    return after, shared_after


def periodic_runs(letters: list[int], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of at least max(least, 2 period) letters, by start, then period."""
    n, found = len(letters), {}
    for w in (letters, [-x for x in letters]):
        after, shared = lyndon_array(w)
        for j, i in enumerate(after):
            if i == n or not shared[j]:
                continue
            period, end = i - j, i + shared[j]
            short = max(2 * period, least) - (end - j)  # how far it must go on to the left
            if short >= period or short > j or (end, period) in found:  # the first root of a run begins within its first period
                continue
            left = max(0, short)
            if w[j - left : j] == w[i - left : i]:
                while left < j and w[j - left - 1] == w[i - left - 1]:
                    left += 1
                found[end, period] = j - left
    return sorted((start, end - start, period) for (end, period), start in found.items())


def repeating(letters: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Stretches of at least `least` letters outside of which no run lies: every letter of a run occurs in it twice, so a letter
    that occurs once in a stretch cuts it. What remains is cut again, ROUNDS times at most: a bound on the time, not on the runs."""
    todo = [(0, len(letters), ROUNDS)]
    while todo:
        a, b, rounds = todo.pop()
        if b - a < least:
            continue
        if not rounds:
            yield a, b
            continue
        _, letter, count = np.unique(letters[a:b], return_inverse=True, return_counts=True)
        cuts = np.flatnonzero(count[letter] == 1)
        if len(cuts):
            edges = np.concatenate([[-1], cuts, [b - a]]).tolist()
            todo += [(a + x + 1, a + y, rounds - 1) for x, y in zip(edges, edges[1:], strict=False) if y - x > least]
        else:
            yield a, b


def runs_of_words(words: list[bytes], least: int) -> list[tuple[int, int, int]]:
    """All runs of a text. The alphabet is ordered by first occurrence in the text."""
    order: dict[bytes, int] = {}
    letters = np.array([order.setdefault(w, len(order)) for w in words], dtype=np.int64)
    return sorted((a + start, length, period) for a, b in repeating(letters, least) for start, length, period in periodic_runs(letters[a:b].tolist(), least))


def collapse_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """All columns of docs, with n_words, runs (start, length and period in words, by start, then period) and collapsed_text:
    the words kept, joined by one space. A word goes if any run contains it after that run's first period.

    docs: text and any more columns; columns of the added names are replaced, all others are passed on unread. Words are
    [^\\x20\\x09-\\x0D]+ over the whole text. Null, empty and blank texts have no words, no runs and an empty collapsed_text; fewer than
    `least` (2 or more) words have no runs; repeated rows are treated one by one; an empty table gives no rows. Rows need
    nothing of one another, so nothing is shuffled; a task holds one batch of texts at a time, a text costs time and memory in proportion to its words.
    """
    if least < 2:
        raise ValueError("least must be 2 or more")
    texts = packed(docs.withColumn("text", F.col("text").cast("string")), ["text"])
    rest = [c for c in texts.columns if c != "text"]
    schema = texts.select(*rest).schema
    for field in StructType.fromDDL(f"n_words long, runs {RUNS}, collapsed_text string, text string"):
        schema = schema.add(field)
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, lists, kept = [], [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode().split()  # splits bytes at exactly \x20 and \x09-\x0D
                runs = runs_of_words(words, least)
                if runs:
                    stay = np.ones(len(words), dtype=bool)
                    for start, length, period in runs:
                        stay[start + period : start + length] = False
                    kept.append(b" ".join([words[k] for k in np.flatnonzero(stay).tolist()]))
                else:
                    kept.append(b" ".join(words))
                counts.append(len(words))
                lists.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
            added = [pa.array(counts, pa.int64()), pa.array(lists, kind), pa.array(kept, pa.binary()).cast(pa.string()), batch.column("text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *added], names=[*rest, "n_words", "runs", "collapsed_text", "text"])

    done = texts.mapInArrow(run, schema)
    return unpacked(done, docs.columns, {c: F.col(c) for c in ("n_words", "runs", "collapsed_text")})


def planted_periods(doc_id: Column, text: Column) -> Column:
    """Text with a period planted by rule into about a tenth of the rows: h = crc32 of the decimal id, g = h div 10; where h ends in 0
    and there are n > 0 words, word i >= a becomes word a + (i - a) mod p, a = g mod n, p = 1 + (n - a) div (3 + g mod 8). Null ids: unchanged."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    n, g = F.size(words).cast("long"), F.floor(h / 10).cast("long")
    a = g % n
    p = F.floor((n - a) / (g % 8 + 3)).cast("long") + 1
    spec = F.struct(words.alias("w"), a.alias("a"), p.alias("p"))
    turned = F.transform(F.array(spec), lambda s: F.array_join(F.transform(s.w, lambda x, i: F.when(i < s.a, x).otherwise(F.get(s.w, (s.a + (i - s.a) % s.p).cast("int")))), " "))[0]
    return F.when((h % 10 == 0) & text.rlike(WORD), turned).otherwise(text)


def longest_run(runs: Column) -> Column:
    """Struct (length, start, period) of the longest run, the one that starts first, of the smallest period on ties; null if none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    return F.when(best.isNotNull(), F.struct(best.length.alias("length"), (-best.start).alias("start"), (-best.period).alias("period")))
