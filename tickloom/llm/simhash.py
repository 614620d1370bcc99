"""Near duplicates by SimHash: fingerprints linked at a few differing bits through a binary trie joined with itself."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ROW, chunks, materialize, skew_join, with_row_id
from tickloom.llm.components import connected_components

SEED = 42
LEAF_PAIRS = 4_000_000  # that a task compares at once, at most


def fingerprint(text: bytes, words: int) -> int:
    """A bit is 1 if it is set in over half the XXH64 of the text's word shingles, repeats included; no words: 0."""
    text = b" ".join(text.lower().split())
    if not text:
        return 0
    gaps = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(text)]
    h = xxhash.xxh64_intdigest
    hashes = [h(text[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)] or [h(text, SEED)]
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int.from_bytes(np.packbits(over).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs' other columns with fp, a signed long of 64 bits, for text: A-Z lower-cased, split at ASCII white space.
    Texts of fewer words are one shingle; null and empty texts have fingerprint 0."""
    rest = [c for c in docs.columns if c != "text"]
    schema = docs.select(*rest, F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                raw = part.column("text").cast(pa.large_binary())
                fp = pa.array([fingerprint(x.as_py() or b"", words) for x in raw], pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], fp], names=[*rest, "fp"])

    return docs.mapInArrow(run, schema)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_pairs(a: np.ndarray, b: np.ndarray, budget: int, small: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values at most `budget` bits apart. a, b: sorted uint64 arrays, each the leaves of a binary trie.

    A node is a run of its array. Node pairs go down a bit at a time together, all pairs of a level at once; a pair whose
    prefixes differ in more bits than the budget is dropped, and one with few leaves is compared leaf by leaf.
    """
    if not len(a) or not len(b):
        return
    al, ah, bl, bh, err = (np.array([x], dtype=np.int64) for x in (0, len(a), 0, len(b), 0))
    for depth in range(65):
        few = (ah - al) * (bh - bl) <= small if depth < 64 else np.ones(len(al), dtype=bool)
        if few.any():
            na, nb = (ah - al)[few], (bh - bl)[few]
            which = np.repeat(np.arange(len(na)), na * nb)
            at = np.arange(len(which)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            i, j = al[few][which] + at // nb[which], bl[few][which] + at % nb[which]
            near = popcount(a[i] ^ b[j]) <= budget
            yield i[near], j[near]
        if few.all():
            return
        al, ah, bl, bh, err = (x[~few] for x in (al, ah, bl, bh, err))
        shift = np.uint64(63 - depth)
        mid = lambda v, lo: np.searchsorted(v, ((v[lo] >> shift) | np.uint64(1)) << shift)
        am, bm = np.clip(mid(a, al), al, ah), np.clip(mid(b, bl), bl, bh)
        al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*[(p, q, r, s, err + e) for p, q, r, s, e in ((al, am, bl, bm, 0), (am, ah, bm, bh, 0), (al, am, bm, bh, 1), (am, ah, bl, bm, 1))], strict=True))
        live = (ah > al) & (bh > bl) & (err <= budget)
        al, ah, bl, bh, err = (x[live] for x in (al, ah, bl, bh, err))
        if not len(al):
            return


def turned(fp: np.ndarray, bits: int) -> np.ndarray:
    """uint64 values turned left by so many bits."""
    return fp << np.uint64(bits) | fp >> np.uint64(64 - bits) if bits else fp


def _links(table: pa.Table, budget: int) -> pa.Table:
    """Within a subtrie and its neighbours: for each linked fingerprint the smallest index it is connected with here."""
    fp, own = table.column("fp").to_numpy().view(np.uint64), table.column("own").to_numpy(zero_copy_only=False)
    turn = table.column("turn")[0].as_py()
    a, b = np.unique(fp[own]), np.unique(fp)
    parent = np.arange(len(b))
    place = np.searchsorted(b, a)
    step = max(1, min(2048, LEAF_PAIRS // len(b)))
    for at in range(0, len(a), step):
        for i, j in trie_pairs(a[at : at + step], b, budget):
            i = place[at + i]
            i, j = i[i != j], j[i != j]
            while len(i):
                x, y = parent[i], parent[j]
                apart = x != y
                i, j, x, y = i[apart], j[apart], x[apart], y[apart]
                np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
                while (parent[parent] != parent).any():
                    parent = parent[parent]
    moved = np.flatnonzero(parent != np.arange(len(b)))
    back = turned(b, (64 - turn) % 64)
    return pa.table({"a": back[moved].view(np.int64), "b": back[parent[moved]].view(np.int64)})


def trie_links(points: DataFrame, budget: int = 2, subtrie: int = 128, turns: int = 1) -> DataFrame:
    """Links (a, b) between distinct fingerprints (points: one long column fp, no repeats) that connect exactly those
    which a chain of pairs within `budget` bits connects; a link's ends may be a chain apart.

    The top levels of the trie, so many that a subtrie holds `subtrie` fingerprints on average, are walked in Spark: a
    pair of nodes within the budget meets at one of the two, chosen by a hash. A subtrie of more fingerprints is dealt
    out in parts of about 16 times `subtrie`. Below, each task walks node pairs down to the leaves.

    turns: so many tries, each over the fingerprints turned to begin with another of that many equal blocks. Of a pair
    within the budget one block differs in at most budget // turns bits, so the top levels, which end with the block,
    need no larger budget than that: many turns make a large budget cheap.
    """
    n, width = points.count(), 64 // turns
    depth = min(max(0, math.ceil(math.log2(max(1, n / subtrie)))), width if turns > 1 else 64)
    top = (lambda c: F.shiftrightunsigned(c, 64 - depth)) if depth else (lambda c: F.lit(0).cast("long"))
    flips = [sum(1 << p for p in ps) for ps in _positions(depth, budget // turns)]
    begins = [width * t for t in range(turns)]
    views = [F.struct(F.lit(s).alias("turn"), (F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", 64 - s)) if s else F.col("fp")).alias("fp")) for s in begins]
    tops = points.select(F.inline(F.array(*views))).select("turn", "fp", top("fp").alias("u"))
    parts = tops.groupBy("turn", "u").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / (16 * subtrie))).cast("int").alias("parts"))
    own = tops.select("turn", "fp", F.col("u").alias("node"), F.lit(True).alias("own"))
    pairs = tops.withColumn("v", F.explode(F.array(*[F.col("u").bitwiseXOR(F.lit(x).cast("long")) for x in flips]))) if flips else None
    low, high = F.least("u", "v"), F.greatest("u", "v")
    here = F.when(F.xxhash64(low, high) % 2 == 0, low).otherwise(high)
    sent = tops.select("turn", "fp", F.col("u").alias("node"), F.lit(False).alias("own"))
    if pairs is not None:
        sent = sent.unionByName(pairs.filter(here == F.col("v")).select("turn", "fp", F.col("v").alias("node"), F.lit(False).alias("own")))
    seen = own.unionByName(sent).join(parts.withColumnRenamed("u", "node"), ["turn", "node"])
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = seen.withColumn("part", F.explode(F.when(F.col("own"), F.array(mine)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    return dealt.select("turn", "node", "part", "fp", "own").groupBy("turn", "node", "part").applyInArrow(lambda t: _links(t, budget), "a long, b long")


def _positions(depth: int, budget: int) -> list[tuple[int, ...]]:
    from itertools import combinations

    return [c for k in range(1, budget + 1) for c in combinations(range(depth), k)]


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 2, turns: int = 1) -> DataFrame:
    """doc_id, row id, fingerprint fp, component_id, the smallest doc_id that links at `budget` bits or fewer reach, and keeper,
    the row id of the one document of the group that a deduplication keeps: that doc_id's, the first scanned if repeated.

    docs: doc_id, text; others aren't used. Every row gets a result. Equal fingerprints are one point, so a group of
    copies of any size is one point too; only (row, doc_id, fp) is shuffled. Texts without words have fingerprint 0
    and link to one another. Null doc_ids count as larger than any; an empty table gives no rows.
    """
    marked = materialize(fingerprints(with_row_id(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))), words))
    points = materialize(marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW)).alias("least")))
    joined = connected_components(trie_links(points.select("fp"), budget, turns=turns), "a", "b")
    classes = points.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = classes.groupBy("component").agg(F.min("least").alias("least"))
    named = skew_join(classes.select("fp", "component"), smallest, ["component"]).select("fp", F.col("least.doc_id").alias("component_id"), F.col(f"least.{ROW}").alias("keeper"))
    return skew_join(marked, materialize(named), ["fp"], "left")
