"""Quality selection by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ROW, WORD_ODD, bytes_and_offsets, chunks, global_order, materialize, mixed, packed, unpacked, with_row_id, word_hashes, word_spans

LENGTH_POWER = 0.5


class RatioModel(NamedTuple):
    """log_ratio: log target / raw probability of each hashed n-gram bucket. threshold: of a good document's score."""

    log_ratio: np.ndarray
    threshold: float


def features(batch: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word pairs of a batch's texts: the row of each, and its bucket."""
    data, offsets = bytes_and_offsets(batch.column("text"))
    starts, ends, first = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    row = np.repeat(np.arange(batch.num_rows), np.diff(first))
    joined = row[:-1] == row[1:]
    pairs = mixed(h[:-1] * np.uint64(WORD_ODD) + h[1:])[joined]
    return np.concatenate([row, row[:-1][joined]]), (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(np.int64)


def labelled_sample(labels: DataFrame, bound: int = 20_000) -> DataFrame:
    """(doc_id, good) of at most `bound` labelled documents, chosen by a hash of the id: the only bounded part of the fit.
    good: quality 1 and, if there is such a column, not toxic."""
    clean = (F.coalesce("toxic", F.lit(0)) == 0) if "toxic" in labels.columns else F.lit(True)
    rows = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", ((F.col("quality") == 1) & clean).alias("good"), (F.col("quality") == 0).alias("bad"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).groupBy("doc_id").agg(F.min("good").alias("good"), F.max("bad").alias("bad"))


def bucket_counts(docs: DataFrame, sample: DataFrame, buckets: int) -> DataFrame:
    """(bucket, raw, target) counts: raw over the n-grams of all documents, target over the good ones of the sample. Each
    task sums its own rows first, so what is shuffled is a row a bucket and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in chunks(batch):
                row, bucket = features(part, buckets)
                good = part.column("good").fill_null(False).to_numpy(zero_copy_only=False)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[good[row]], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])

    marked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id", "left").select("text", "good")
    return marked.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def scored(docs: DataFrame, log_ratio: np.ndarray) -> DataFrame:
    """docs (text and any more columns) with score: the sum of the log ratios of the text's n-grams over the square root of
    their number; a text without words scores 0."""
    buckets, schema = len(log_ratio), docs.select("*", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                row, bucket = features(part, buckets)
                n = np.bincount(row, minlength=part.num_rows)
                total = np.bincount(row, weights=log_ratio[bucket], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(total / np.maximum(n, 1) ** LENGTH_POWER)], names=[*part.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def best_threshold(scores: np.ndarray, good: np.ndarray, bad: np.ndarray, keep_weight: float) -> float:
    """Score from which a document counts as good, by the labelled sample: the most good ones kept, keep_weight times as
    heavy, and bad ones turned away."""
    if not good.any() or not bad.any():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    s, g, b = scores[order], good[order], bad[order]
    gain = keep_weight * (1 - np.concatenate([[0], np.cumsum(g)[:-1]]) / g.sum()) + np.concatenate([[0], np.cumsum(b)[:-1]]) / b.sum()
    at = int(np.argmax(gain))
    return float((s[at] + s[at - 1]) / 2) if at else -np.inf


def words_of(text: Column) -> Column:
    """Distinct lower-cased runs of letters."""
    return F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"))


def toxic_words(docs: DataFrame, labels: DataFrame, bound: int = 20_000, keep_weight: float = 3.0) -> list[str]:
    """Words that give a document away as toxic, from at most `bound` labelled documents (labels: doc_id, toxic).

    A word counts if it is more frequent among toxic documents than chance would make any of the words seen, by the
    Chernoff bound at 0.05. Its score is the log ratio of its shares of toxic and clean documents; words are given from
    the score on that turns most toxic documents away, less keep_weight times the share of clean ones that go too. Without labels of both kinds there are none.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = materialize(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select(F.monotonically_increasing_id().alias(ROW), (F.col("toxic") == 1).alias("bad"), words_of(F.col("text")).alias("words")))
    bad, clean = rows.agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first()
    if not bad or not clean:
        return []
    seen = materialize(rows.select("bad", F.explode("words").alias("w")).filter("w <> ''").groupBy("w").agg(F.count_if("bad").alias("t"), F.count("*").alias("n")))
    at, chance = F.col("t") / F.col("n"), F.lit(bad / (bad + clean))
    distance = at * F.log(at / chance) + F.when(at < 1, (1 - at) * F.log((1 - at) / (1 - chance))).otherwise(0.0)
    sure = F.col("n") * distance >= F.lit(float(np.log(max(seen.count(), 1) / 0.05)))
    score = F.log(F.col("t") / F.lit(float(bad))) - F.log((F.col("n") - F.col("t") + 1) / F.lit(float(clean)))
    scores = {r.w: r.s for r in seen.filter((F.col("t") > 0) & (at > chance) & sure).select("w", score.alias("s")).collect()}  # few: bounded by the sample
    if not scores:
        return []
    found = rows.select("bad", F.array_intersect("words", F.array(*map(F.lit, scores))).alias("hits")).collect()
    highest = np.array([max((scores[w] for w in r.hits), default=-100.0) for r in found])
    toxic = np.array([r.bad for r in found])
    order = np.sort(np.unique(highest[toxic]))
    gain = [(highest[toxic] >= x).mean() - keep_weight * (highest[~toxic] >= x).mean() for x in order]
    least = order[int(np.argmax(gain))]
    return sorted(w for w, x in scores.items() if x >= least)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text and any more columns) less those with a toxic word, however long they are."""
    if "toxic" not in labels.columns:
        return docs
    words = toxic_words(docs, labels)
    return docs.filter(~F.arrays_overlap(words_of(F.col("text").cast("string")), F.array(*map(F.lit, words)))) if words else docs


def gumbel_key(score: Column, temperature: float, seed: Column | int) -> Column:
    """Rows of the largest keys are a sample without replacement by weights exp(score / temperature); the noise hangs on doc_id
    and seed alone."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    unit = (F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), seed), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return score / F.lit(temperature) - F.log(-F.log(unit))


def importance_resample(
    docs: DataFrame, labels: DataFrame, buckets: int = 16_384, temperature: float = 0.02, k: int | None = None,
    keep_weight: float = 3.0, sample_bound: int = 20_000, seed: int = 42,
) -> DataFrame:
    """The k documents of the largest Gumbel keys, score / temperature + Gumbel noise: a sample without replacement by
    importance weights exp(score / temperature). All columns of docs, with score added.

    docs: doc_id, text and any more; labels: doc_id, quality and maybe toxic. Raw counts take in every document, target
    counts the good ones among at most sample_bound labelled documents. k None: as many as score like the labelled good
    ones, so that low temperatures keep clean documents and leave chance to the border. Without labels of both kinds all
    documents count as good. The noise hangs on doc_id and seed alone. Null and empty texts score 0; repeated rows and
    ties are ordered by doc_id, then scan order; an empty table gives no rows.
    """
    sample = materialize(labelled_sample(labels, sample_bound))
    log_target, log_raw = np.ones(buckets), np.ones(buckets)
    for bucket, raw, target in bucket_counts(docs, sample, buckets).collect():  # as many rows as buckets
        log_raw[bucket] += raw
        log_target[bucket] += target
    log_ratio = np.log(log_target / log_target.sum()) - np.log(log_raw / log_raw.sum())
    key = gumbel_key(F.col("score"), temperature, seed)
    marked = scored(with_row_id(packed(docs, ["doc_id", "text"]).withColumn("text", F.col("text").cast("string"))), log_ratio).withColumn("_key", key)
    chosen = lambda which: unpacked(marked.filter(which), docs.columns, {"score": F.col("score")})
    keys = materialize(marked.select("doc_id", ROW, "score", "_key"))
    if k is None:
        labelled = keys.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("score").alias("score"), F.first("good").alias("good"), F.first("bad").alias("bad"))
        known = np.array(labelled.select("score", "good", "bad").collect(), dtype=float).reshape(-1, 3)  # a row a labelled document: sample_bound at most
        threshold = best_threshold(known[:, 0], known[:, 1] > 0, known[:, 2] > 0, keep_weight)
        k = keys.filter(F.col("score") >= F.lit(threshold)).count()
    ranked = global_order(keys, [F.col("_key").desc(), F.col("doc_id").asc(), F.col(ROW).asc()])
    last = ranked.filter(F.col("idx") == k - 1).first()
    if last is None:  # none, or more than there are
        return chosen(F.lit(k > 0))
    tie = F.struct(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0).cast("long")), ROW) <= F.struct(F.lit(last.doc_id is not None), F.lit(last.doc_id or 0).cast("long"), F.lit(last[ROW]).cast("long"))
    return chosen((F.col("_key") > F.lit(last["_key"])) | ((F.col("_key") == F.lit(last["_key"])) & tie))
