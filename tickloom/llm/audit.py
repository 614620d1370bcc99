"""Interaction of filters: what each removes, shares with others or alone turns away, under every order they can be applied in.

Each document is a mask of the filters that it fails. All that the audit needs of the corpus is a histogram of masks per part, once
over all documents, once over the good and once over the toxic ones. What becomes of a mask under an order and a step doesn't depend
on the corpus: one integer matrix each for kept, removed, redundant and unique outcomes, with a row a mask and a column an order and step.
The audit is the product of histograms, stacked as rows, and those matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialize, skew_join

LABELS = ("all", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
PARTS_AT_ONCE = 64


def outcomes(filters: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """All (order, step), and per outcome a matrix of 0 and 1 with a row a mask (bit k: fails filter k) and a column an order and step."""
    columns = [("".join(order), step) for order in permutations(filters) for step in range(1, len(filters) + 1)]
    masks = np.arange(1 << len(filters))
    bits = lambda letters: sum(1 << filters.index(x) for x in letters)
    earlier = np.array([bits(order[: step - 1]) for order, step in columns])
    own = np.array([bits(order[step - 1]) for order, step in columns])
    gone, fails = (masks[:, None] & earlier) != 0, (masks[:, None] & own) != 0
    found = {"kept": ~gone & ~fails, "removed": ~gone & fails, "redundant": gone & fails, "unique_fails": masks[:, None] == own}
    return columns, {k: m.astype(np.int64) for k, m in found.items()}


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text fails: A under 200 words; B distinct words under half of the words; C capitals A-Z over 3 in 100 code points;
    D any of #$%&*|. Words are maximal [^\\x20\\x09-\\x0D]+. Null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 50,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 3,
        "D": text.rlike("[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, labels: DataFrame, part: str, filters: dict[str, Column]) -> DataFrame:
    """(part, good, toxic, mask) for each document; the last bit is for texts that a smaller doc_id has too."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mask = sum([F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(filters.values())], F.lit(0))
    slim = materialize(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")))
    marks = labels.select(F.col("doc_id").cast("long"), *[F.coalesce(F.col(column) == 1, F.lit(False)).alias(name) for name, column in (("good", "quality"), ("toxic", "toxic"))])
    marks = marks.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    first = slim.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").select("h1", "h2", "first")
    met = skew_join(skew_join(slim, first, ["h1", "h2"], "left"), marks, ["doc_id"], "left")
    repeat = F.when(F.col("doc_id") > F.col("first"), 1 << len(filters)).otherwise(0)
    return met.select("part", *[F.coalesce(c, F.lit(False)).alias(c) for c in LABELS[1:]], F.col("mask").bitwiseOR(repeat).alias("mask"))


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: dict[str, Column] | None = None, repeats: str = "E") -> DataFrame:
    """One row for each part, order of the filters and step, zeros included: part, filter_order, step and the numbers of documents of the
    part: kept after the step, removed by it, redundant (fail its filter, removed earlier), unique_fails (fail its filter only),
    good_lost and toxic_lost (removed by it, with label quality or toxic 1), shapley (removed by its filter at any step, summed over all orders).

    docs: doc_id, text, the part's column and any more, which aren't used. labels: doc_id, quality, toxic. filters: a letter and a
    condition that holds for texts which fail, evaluated on docs (default text_filters); repeats: the letter of the filter that fails
    texts identical to one of a smaller doc_id, anywhere in the table, removed or not.
    Null texts count as empty, null parts as ''. A null doc_id is no smaller than any, fails no `repeats` and has no label; rows repeated
    with their id aren't copies of one another; a document with several label rows has what any of them says. An empty table gives no rows.

    Texts are read once and only ids, two 64-bit hashes and masks are shuffled, by joins whose hot keys AQE can split. Histograms combine before the
    shuffle; a part has 2 ** filters numbers a label, and parts are multiplied in slices of PARTS_AT_ONCE.
    """
    filters = text_filters(F.col("text")) if filters is None else filters
    letters = "".join(filters) + repeats
    size = 1 << len(letters)
    rows = failure_masks(docs, labels, part, filters).groupBy("part", "mask").agg(F.count("*").alias("all"), *[F.count_if(c).alias(c) for c in LABELS[1:]])
    histogram = rows.groupBy("part").agg(*[F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long") for m in range(size)]).alias(c) for c in LABELS])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, matrix = outcomes(letters)
        orders, steps = pa.array([o for o, _ in columns]), np.array([s for _, s in columns], dtype=np.int32)
        own = np.array([letters.index(o[s - 1]) for o, s in columns])
        whose = (own[:, None] == np.arange(len(letters))).astype(np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                some = batch.slice(at, PARTS_AT_ONCE)
                n = some.num_rows
                stacked = np.concatenate([some.column(c).flatten().to_numpy().reshape(n, size) for c in LABELS])
                removed = stacked @ matrix["removed"]
                done = {k: stacked[:n] @ matrix[k] for k in ("kept", "redundant", "unique_fails")}
                done |= {"removed": removed[:n], "good_lost": removed[n : 2 * n], "toxic_lost": removed[2 * n :], "shapley": (removed[:n] @ whose)[:, own]}
                parts = some.column("part").take(pa.array(np.repeat(np.arange(n), len(columns))))
                names = pa.concat_arrays([orders] * n)
                yield pa.RecordBatch.from_arrays([parts, names, pa.array(np.tile(steps, n)), *[pa.array(done[k].ravel()) for k in COUNTS]], names=["part", "filter_order", "step", *COUNTS])

    return histogram.mapInArrow(multiply, "part string, filter_order string, step int, " + ", ".join(f"{k} long" for k in COUNTS))
