"""What the first review found missing, held against plain versions that share no gate with the operators."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from tickloom.llm.importance import without_toxic
from tickloom.llm.shingles import similar_documents


def shingles(text, words=5):
    w = brute.WORD.findall((text or "").encode().lower())
    return {tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1 if w else 0))}


def similar_keepers(docs):
    """The smallest id of each group of documents that pairs of Jaccard similarity 0.8 or more connect."""
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return set(brute.components(ids, linked).values())


def test_near_dedup_finds_all_and_only_alike(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows = []
    for n in (40, 80, 200, 600):
        for _ in range(10):
            words = list(rng.choice(vocabulary, n))
            rows.append(" ".join(words))
            for share in (0.01, 0.02, 0.03, 0.06):  # below and above the border
                copy = list(words)
                for at in rng.choice(n, max(1, int(n * share)), replace=False):
                    copy[at] = "CHANGED" + str(at)
                rows.append(" ".join(copy))
    rows = [(i, t) for i, t in enumerate([*rows, "", None, "a b", "A  b\n", "a b c d e"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1)})
    want = similar_keepers(rows)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()} == want
    missed = {c for _, _, c in brute.simhash_components(rows, 5, 7)}
    assert missed != want and len(want) < len(rows)


def test_near_dedup_on_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = similar_keepers([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = similar_documents(docs).collect()
    assert len(got) == docs.count() and {r.doc_id for r in got if r._row == r.keeper} == want
    assert not similar_documents(docs.limit(0)).count()


def test_quality_rejects_toxic_documents(spark, sf_dir):
    path = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality")).join(docs.select("doc_id").distinct(), "doc_id")
    fit, held = (labels.filter(F.xxhash64("doc_id") % 2 == 0), known.filter(F.xxhash64("doc_id") % 2 != 0).filter("quality = 1"))
    kept = held.join(without_toxic(docs, fit), "doc_id", "left_semi")
    share = lambda t: kept.filter(f"toxic = {t}").count() / held.filter(f"toxic = {t}").count()
    assert share(1) <= 0.2 and share(0) >= 0.98  # on labels that the fit has not seen
    assert without_toxic(docs, labels.filter("toxic = 0")).count() == docs.count() == without_toxic(docs, labels.drop("toxic")).count()
    assert not without_toxic(docs.limit(0), labels).count()
