import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_advice_r01 import similar_keepers
from tickloom.llm import linededup
from tickloom.llm import queries as Q
from tickloom.llm.common import with_row_id
from tickloom.llm.components import connected_components
from tickloom.llm.importance import importance_resample
from tickloom.llm.linededup import dedup_lines, grouped_simhash
from tickloom.llm.mixing import mix_sources
from tickloom.llm.packing import best_two_fit, pack_documents
from tickloom.llm.pivots import top_products
from tickloom.llm.sharding import shard_documents
from tickloom.llm.simhash import near_duplicates, trie_pairs
from tickloom.llm.substring import dedup_substrings
from tickloom.llm.vptree import nearest_vectors
from tickloom.llm.warc import Archive, assemble, read_records, write_warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(df):
    return {tuple(r) for r in df.collect()}


def texts(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, ties, a long text, a long word, and columns whose names clash with the operators' own."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, passage), (6, "head " + passage + " tail"), (7, passage), (7, passage), (8, "x" * 40_000), (9, ("lorem ipsum dolor sit amet " * 4 + "\n") * 300), (None, "no id " + passage)]
    base = spark.createDataFrame([(i, t, None if i == 4 else "en", "s0", len(t or "")) for i, t in rows], DOCS)
    return base.withColumns({c: F.lit(7) for c in ("_row", "_rest", "score", "shard", "slot", "component", "pid", "idx", "ln", "first", "p", "tokens", "spans", "full", "anchor", "fp", "size")})


def test_warc_matches_brute_force_and_round_trips(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()]
    assert plain(Q.op1_warc_assembly(spark, sf_dir)) == brute.warc(pages)


def test_warc_edges(spark, tmp_path):
    rows = [(1, "http://a.org/x?y#z", "<p>\r\n\r\nWARC/1.1\r\nWARC-Type: request</p>"), (2, None, None), (3, "u r\nl", ""), (4, "http://a.org/x", "<p>\r\n\r\nWARC/1.1\r\nWARC-Type: request</p>"), (5, "", "é\x00 \n"), (None, "http://b.org", "é\x00 \n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("type", "key", "digest", "block")})
    archive = write_warc(pages, f"file://{tmp_path}/a")
    got = assemble(read_records(spark, archive)).select("page_id", "response.payload_bytes", "response.payload_digest", "response.type", "response.refers_to_page").collect()
    assert {tuple(r) for r in got if r[0] is not None} == {(*r[:3], *r[3:]) for r in brute.warc([(p, h) for p, _, h in rows if p is not None])}
    assert [r[3:] for r in got if r[0] is None] == [("revisit", 5)]
    bodies = dict(assemble(read_records(spark, archive)).filter("response.type = 'response'").select("page_id", "response.payload").collect())
    assert bodies == {1: rows[0][2], 2: "", 5: "é\x00 \n"}
    big = write_warc(pages, f"file://{tmp_path}/b", min_revisit_bytes=10)
    assert assemble(read_records(spark, big)).filter("response.type = 'revisit'").count() == 1
    none = write_warc(pages.limit(0), f"file://{tmp_path}/c")
    assert read_records(spark, none).select("type").first()[0] == "warcinfo" and not assemble(read_records(spark, none)).count()
    records = read_records(spark, archive)
    with pytest.raises(Exception, match="digest differs"):
        assemble(records.withColumn("block", F.regexp_replace("block", "<p>", "<q>"))).select("response").collect()
    with pytest.raises(Exception, match="broken record"):
        read_records(spark, Archive(archive.path, archive.warcinfo)).withColumn("block", F.col("block"))
        spark.createDataFrame([(archive.head + "WARC-Type: response\r\nContent-Length: 9\r\n\r\nshort\r\n\r",)], "value string").write.text(f"file://{tmp_path}/d")
        read_records(spark, Archive(f"file://{tmp_path}/d", archive.warcinfo)).select("block").collect()


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (35, 2))] + [(100 + i, 101 + i) for i in range(30)] + [(500, 501 + i) for i in range(50)]
    want = brute.components({x for e in edges for x in e if e[0] != e[1]}, [e for e in edges if e[0] != e[1]])
    frame = spark.createDataFrame([*edges, (3, None), (9, 9)], "a long, b long")
    assert plain(connected_components(frame, "a", "b")) == set(want.items())
    assert not connected_components(frame.limit(0), "a", "b").count()


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_trie_pairs(budget):
    rng = np.random.default_rng(budget)
    seed = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.concatenate([seed, *[seed ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(3)]])
    a, b = np.unique(near[::2]), np.unique(near)
    got = {(int(i), int(j)) for x, y in trie_pairs(a, b, budget, small=4) for i, j in zip(x, y, strict=True)}
    assert got == {(i, j) for i in range(len(a)) for j in range(len(b)) if (int(a[i]) ^ int(b[j])).bit_count() <= budget}


def test_simhash_matches_brute_force(spark, sf_dir):
    assert plain(Q.op5_simhash_trie(spark, sf_dir)) == brute.simhash_components(texts(spark, sf_dir))


def test_simhash_dense_and_edges(spark, odd):
    rows = [(i, " ".join(f"w{j}" if j != i % 50 else "changed" for j in range(300))) for i in range(120)]
    assert {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), budget=3).collect()} == {(d, c) for d, _, c in brute.simhash_components(rows, budget=3)}
    for budget, turns in ((7, 4), (5, 3), (2, 2)):
        assert {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), budget=budget, turns=turns).collect()} == {(d, c) for d, _, c in brute.simhash_components(rows, budget=budget)}
    got = near_duplicates(odd).select("doc_id", "component_id").collect()
    assert len(got) == odd.count() and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in got if r.doc_id in (5, 7)} == {5}
    assert not near_duplicates(odd.limit(0)).count()
    import corpus_pipeline

    ids = [r.doc_id for r in corpus_pipeline.near_dedup(spark, odd, "").collect()]
    assert sorted(ids, key=str) == [1, 4, 5, 8, 9] or sorted(ids, key=str) == [1, 4, 5, 6, 8, 9, None]


def test_near_dedup_verifies_links_of_the_trie(spark, monkeypatch):
    """The pipeline's near duplicates come through op5's trie; its links are candidates, and what it misses is found all the same."""
    import corpus_pipeline as P
    from tests.llm.test_advice_r01 import similar_keepers
    from tickloom.llm import shingles

    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(2000)]
    base = [" ".join(rng.choice(words, 200)) for _ in range(20)]
    rows = [(3 * i + k, t + " " + tail) for i, t in enumerate(base) for k, tail in enumerate(("", "one more", " ".join(rng.choice(words, 30 + 10 * (i % 5)))))] + [(90, None), (91, ""), (92, base[0] + " ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1)})
    seen, tried = [], []
    monkeypatch.setattr(P, "near_duplicates", lambda docs, **more: seen.append(more) or near_duplicates(docs, **more))
    pairs = shingles.grouped_points
    monkeypatch.setattr(shingles, "grouped_points", lambda *tables: tried.append(pairs(*tables)) or tried[-1])
    assert {r.doc_id for r in P.near_dedup(spark, frame, "").collect()} == similar_keepers(rows)
    assert seen == [{"words": 3, "budget": 2}] and tried[0].count() > 0


def test_word_hashes_are_xxh64(spark):
    import xxhash
    from tickloom.llm.common import bytes_and_offsets, word_hashes, word_spans

    rng = np.random.default_rng(1)
    words = [rng.bytes(int(n)).translate(bytes(33 + b % 200 for b in range(256))) for n in [*range(1, 80), *rng.integers(1, 2000, 200)]]
    data = b" ".join(words)
    starts, ends, _ = word_spans(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
    for seed in (0, 42):
        assert word_hashes(np.frombuffer(data, dtype=np.uint8), starts, ends, seed).tolist() == [xxhash.xxh64_intdigest(w, seed) for w in words]
    assert not len(word_hashes(*[np.zeros(0, dtype=t) for t in (np.uint8, np.int64, np.int64)]))
    # words that differ in every byte, yet are equal under any power sum modulo 2**64
    turn = [bin(i).count("1") % 2 for i in range(1024)]
    rows = [(i, " ".join([*map(str, range(17)), w, *map(str, range(17, 34))])) for i, w in enumerate(("".join("ab"[t] for t in turn), "".join("ba"[t] for t in turn)))]
    assert {r.n_removed for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), window=35).collect()} == {0}


def test_substrings_match_brute_force(spark, sf_dir):
    assert plain(Q.op7_seed_and_extend(spark, sf_dir)) == brute.substrings(texts(spark, sf_dir))


def test_substrings_planted_and_edges(spark, odd):
    rng = np.random.default_rng(3)
    words = [f"v{i}" for i in range(4)]
    line = lambda n: " ".join(rng.choice(words, n))
    shared = [line(n) for n in (7, 8, 9, 12, 20)]
    rows = [(i, " ".join([line(3), shared[i % 5], line(2), shared[i % 3], "end " * (i % 30)])) for i in range(80)]
    cut = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), window=8, gram=3)
    assert plain(cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))) == brute.substrings(rows, 8)
    got = dedup_substrings(odd)
    assert set(odd.columns) - set(got.columns) == {"text"} and got.count() == odd.count()
    by = {r.doc_id: r for r in got.collect()}
    assert (by[1].n_words, by[1].kept_text, by[5].n_removed, by[6].kept_text, by[8].n_removed) == (0, "", 60, "head tail", 0) and by[6].spans[0].start == 1 and by[None].kept_text == "no id"
    assert not dedup_substrings(odd.limit(0)).count()


def test_nearest_and_top(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    exact = brute.nearest(rows, 20, 20)
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in nearest_vectors(frame, k=20, factor=1.0, shard_rows=200, leaf=16).collect()}
    assert got.keys() == exact.keys() and all(got[k][0] == v[0] and abs(got[k][1] - v[1]) < 1e-12 for k, v in exact.items())
    loose = Q.op8_vantage_trees(spark, sf_dir).collect()
    found = {(r.query_id, r.vec_id) for r in loose}
    assert len(found & {(q, v[0]) for (q, _), v in exact.items()}) >= 0.9 * len(exact)
    whole = {(r.query_id, r.rank): (r.vec_id, r.score) for r in Q.op9_pivot_topk(spark, sf_dir).collect()}
    assert whole == brute.nearest(rows, 50, 5, integer=True)
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_products(frame, shard_rows=100, pivots=3).collect()} == whole


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [1.0, None]), (100, [inf, 0.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.5]), (4, [1.0]), (5, []), (200, [3e38, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("_row", "dim", "shard", "kind", "vec", "block", "over")})
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in nearest_vectors(frame, factor=1.0).collect()}
    assert got == brute.nearest(rows, 20, 20)
    with pytest.raises(Exception, match="a score does not fit long"):
        top_products(frame).collect()
    top = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_products(frame, query_where="vec_id = 100000").collect()}
    assert not top
    again = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (None, [2.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in nearest_vectors(again).collect() if r.rank == 2) == [(0, 2, 0), (0, 2, 0)]
    assert not nearest_vectors(frame.limit(0)).count() and not top_products(frame.limit(0)).count()


def test_large_whole_numbers(spark):
    """Components beyond 2**22 and scores beyond 2**53 stay exact; far negative candidates that are no result do no harm."""
    found = lambda rows, **more: {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **more).collect()}
    for rows in (
        [(0, [1.0, 1.0]), (1, [float(1 << 23), 0.0]), (2, [1.0, 0.0])],
        [(i, [float((1 << 21) - 1 - i % 3)] * 16) for i in range(12)],
        [(0, [3.0, -1.0]), *[(i, [float(1 << 43) + i % 4, float(i % 3)]) for i in range(1, 30)], (50, [1.0, 0.0])],
        [(0, [1.0, 1.0]), (1, [-1e300, 1e290]), *[(i, [1.0 * i, -2.0]) for i in range(2, 9)]],
    ):
        want = brute.nearest(rows, 50, 5, integer=True)
        assert found(rows) == want == found(rows, shard_rows=4, pivots=2)


def test_equal_and_huge_vectors(spark):
    """Ties go to the smaller id across leaves and shards; a vector of size 1e200 takes no result from the others."""
    rng = np.random.default_rng(8)
    found = lambda rows, **more: {(r.query_id, r.rank): (r.vec_id, r.score) for r in nearest_vectors(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>"), **more).collect()}
    same = rng.normal(size=37)
    rows = [(i, same) for i in range(300)]
    assert found(rows, factor=1.0, leaf=16) == brute.nearest(rows, 20, 20) == found(rows, factor=1.0, leaf=16, shard_rows=70)
    rows = [(i, v * (1e200 if i == 77 else 1e-200 if i == 78 else 1.0)) for i, v in enumerate(rng.normal(size=(300, 9)))]
    assert found(rows, factor=1.0, leaf=16) == brute.nearest(rows, 20, 20) == found(rows, factor=1.0, leaf=16, shard_rows=70)
    rows = [(i, v * 1e200 if i % 40 == 0 else v) for i, v in enumerate(np.abs(rng.normal(size=(300, 9))))]
    assert found(rows, factor=1.0, shard_rows=70) == brute.nearest(rows, 20, 20)


def test_recall_over_shards_and_clusters(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 24))
    rows = [(i, (centres[i % 40] + 0.3 * rng.normal(size=24)).tolist()) for i in range(6000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    found = {}
    for r in nearest_vectors(frame, shard_rows=1000).select("query_id", "vec_id").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 300 * 20


def test_search_is_exact_on_other_rows(spark):
    """Lengths spread over decades, few components, unit lengths: of each the nearest rows, all of them, by default."""
    rng = np.random.default_rng(4)
    normal = rng.normal(size=(2000, 16))
    for x in (normal * rng.lognormal(0, 1, (2000, 1)), normal, np.float32(normal / np.linalg.norm(normal, axis=1)[:, None]).astype(float)):
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in nearest_vectors(frame, "vec_id % 100 = 0").collect()}
        assert got == brute.nearest(rows, 100, 20)
    assert {r.vec_id for r in nearest_vectors(spark.createDataFrame([(i, [1e300]) for i in range(300)], "vec_id long, embedding array<double>"), "vec_id = 200", leaf=16).collect()} == set(range(20))


def test_sharding(spark, sf_dir, odd):
    docs = texts(spark, sf_dir)
    got = Q.op4_minimax_shards(spark, sf_dir).collect()
    import zlib

    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs}
    by_text = {}
    for d, t in docs:
        by_text.setdefault(t, []).append(d)
    sizes = [len(by_text[t]) * (len(t.encode()) + 1) for t in sorted(by_text, key=lambda t: min(by_text[t]))]
    load, slots, place = {}, {}, {r.doc_id: r.shard for r in got}
    for r in got:
        load[r.shard] = load.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(load.values()) == brute.minimax(sizes, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len({place[d] for d in ds}) == 1 for ds in by_text.values())
    edge = shard_documents(odd, 3)
    assert edge.count() == odd.count() and edge.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert edge.agg(F.countDistinct("shard", "slot")).first()[0] == odd.count()
    assert not shard_documents(odd.limit(0)).count()


def test_packing(spark, sf_dir, odd):
    from tokenizers import Tokenizer

    tokenizer, ranks = Q.tokenizer_files()
    plain_coder = Tokenizer.from_file(tokenizer)
    encode = lambda t: plain_coder.encode(t, add_special_tokens=False).ids
    docs = texts(spark, sf_dir)
    got = Q.op6_best_two_fit(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == brute.pieces(docs, encode)
    check_sequences(got, 1024)
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= -(-total // 1024) * 1.02 + 1
    small = pack_documents(odd.unionByName(odd.limit(1).withColumn("text", F.lit("a<|endoftext|>b"))), tokenizer, ranks, capacity=16)
    rows = small.collect()
    check_sequences(rows, 16)
    assert {(r.start, r.length, bytes(r.ids)) for r in rows if r.doc_id == 4} == {(0, 2, np.array([*encode("one"), 2], dtype="<u4").tobytes())}
    assert np.array([*encode("a<|endoftext|>b"), 2], dtype="<u4").tobytes() in {bytes(r.ids) for r in rows}
    assert not pack_documents(odd.limit(0), tokenizer, ranks).count()


def check_sequences(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_best_two_fit_replaces_the_smallest():
    counts = np.zeros(11, dtype=np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]
    assert best_two_fit(counts, 10)[0] == ([6, 2, 2], 1)


def test_line_simhash(spark):
    lines = ["a b c d", "one two three four five", " ".join(f"w{i % 7}" for i in range(63)), " ".join(f"w{i}" for i in range(64)), " ".join(f"w{i % 90}" for i in range(500))]
    frame = spark.createDataFrame([(x,) for x in lines], "t string")
    words = frame.select("t", F.split("t", " ").alias("words")).select("t", F.size("words").alias("n"), F.posexplode("words").alias("pos", "w"))
    want = {x: sum(1 << (i + 16 * j) for b, block in enumerate(brute.line_blocks(x)) for (i, j), bit in zip(((i, j) for i in range(4 * b, 4 * b + 4) for j in range(4)), block, strict=True) if bit) for x in lines}
    for size in (60_000, 50):
        linededup.LANE_WORDS = size
        assert {r.t: r.fp % (1 << 64) for r in grouped_simhash(words, ["t"]).collect()} == want
    linededup.LANE_WORDS = 60_000


@pytest.mark.parametrize("edits", [1, 2])
def test_fuzzy_lines_finds_changed_letters(spark, sf_dir, edits):
    """Real lines with one or two letters changed, put in or left out: told by edit similarity alone, none is missed."""
    rng = np.random.default_rng(edits)
    lines = sorted({n for _, t in texts(spark, sf_dir) for x in (t or "").split("\n") if 40 <= len(n := brute.normalised(x)) < 400 and n.count(" ") > 5})
    lines = [lines[i] for i in rng.choice(len(lines), 150, replace=False)]
    rows = []
    for i, line in enumerate(lines):
        changed = line
        for _ in range(edits):
            at = int(rng.choice([j for j, c in enumerate(changed) if c != " " and j and changed[j - 1] != " "]))
            changed = changed[:at] + ("", "q", "q" + changed[at])[rng.integers(3)] + changed[at + 1 :]
        rows += [(2 * i, line), (2 * i + 1, changed)]
    left = {r.doc_id for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).filter("text <> ''").collect()}
    assert not {d for d in left if d % 2}


def test_long_lines_are_compared_in_letters(spark):
    """The same nine changed letters count alike in lines of 39, 40 and 200 words."""
    rng = np.random.default_rng(2)
    rows = []
    for k, n in enumerate((39, 40, 41, 200)):
        words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)]
        turned = [w if i * 4 // n != 1 or i % 2 else "q" + w[1:] for i, w in enumerate(words)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(turned))]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.filter("text <> ''").collect()} == {0, 2, 4, 6}
    assert plain(got.select("doc_id", "text")) == brute.fuzzy_lines(rows)


def test_fuzzy_lines(spark, odd):
    long = [f"term{i}" for i in range(120)]
    vary = lambda i: " ".join(w if j != i else "other" for j, w in enumerate(long))
    assert brute.edit_distance("kitten", "sitting") == 3
    rows = [(i, "\n".join([f"Page {i} of the very long report number {i * 7}", vary(i), "short", f"unique line {'abc' * i} with letters {'xyz' * i}"])) for i in range(30)] + [(99, None), (100, ""), (101, "page 3 of the VERY long report, number 12!\nshort")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert plain(got.select("doc_id", "text")) == brute.fuzzy_lines(rows)
    edge = dedup_lines(odd)
    assert edge.count() == odd.count() and set(edge.columns) == {*odd.columns, "n_lines_removed"}
    by = {r.doc_id: r for r in edge.collect() if r.doc_id != 7}
    assert by[1].text is None and by[9].n_lines_removed == 299 and by[8].n_lines_removed == 0
    assert not dedup_lines(odd.limit(0)).count()


def raked(spark, docs, fraction, targets=None, temper=0.5):
    """Inclusion probabilities by cell, from the operator over documents that are each taken with p, and by brute force."""
    from tickloom.llm import mixing

    rows = docs.select("source", "lang", "topic", "text").collect()
    tokens = {}
    for r in rows:
        tokens[r.source, r.lang, r.topic] = tokens.get((r.source, r.lang, r.topic), 0) + len((r.text or "").split())
    shares = []
    for d, name in enumerate(("source", "lang", "topic")):
        levels = {}
        for c, t in tokens.items():
            levels[c[d]] = levels.get(c[d], 0) + t
        shares.append(targets[name] if name in (targets or {}) else {x: t**temper for x, t in levels.items()})
    want, aims = brute.mixing(tokens, shares, fraction)
    keys = [f"_{d}" for d in mixing.DIMENSIONS]
    levelled = docs.withColumns({k: mixing.level(d) for k, d in zip(keys, mixing.DIMENSIONS, strict=True)}).withColumn("tokens", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\n]"), lambda w: w != "")))
    cells, miss = mixing.fitted_cells(levelled, keys, targets or {}, temper, fraction, 1e-7)
    plain_level = lambda x: None if x == "null" else x[1:]
    got = {tuple(plain_level(r[k]) for k in keys): min(1.0, r.w) for r in cells.collect()}
    return got, want, tokens, aims, miss


def test_mixing_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("topic", F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("t"), F.col("doc_id") % 3)))
    lang = {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}
    both = {"lang": lang, "topic": {"t0": 0.5, "t1": 0.3, None: 0.2}}
    for fraction, targets, meets, close in ((0.05, None, True, 1e-5), (0.8, None, True, 0.02), (0.3, both, False, 1e-4)):
        got, want, tokens, aims, miss = raked(spark, docs, fraction, targets)
        assert got.keys() == want.keys() and max(abs(got[c] - p) for c, p in want.items()) < close
        taken = [{x: sum(t * got[c] for c, t in tokens.items() if c[d] == x) for x in aims[d]} for d in range(3)]
        worst = max(abs(taken[d][x] - aim) for d in range(3) for x, aim in aims[d].items()) / (fraction * sum(tokens.values()))
        assert (worst < 1e-3) == meets and abs(worst - miss) < 1e-6  # what is told is what is missed


def test_mixing_sample_and_edges(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    half = mix_sources(docs, fraction=0.5)
    ps = {r.doc_id: (r.p, r.tokens) for r in half.collect()}
    assert all(0 < p <= 1 for p, _ in ps.values())
    assert abs(sum(t / p for p, t in ps.values()) / docs.agg(F.sum(F.size(F.split("text", "[ \n]+")))).first()[0] - 1) < 0.4
    assert plain(half.select("doc_id", F.round("p", 6))) == plain(mix_sources(docs.repartition(3), fraction=0.5).select("doc_id", F.round("p", 6)))
    assert mix_sources(odd, fraction=1.0).count() == odd.count() and not mix_sources(odd.limit(0)).count()
    assert not mix_sources(docs, targets={"lang": {"xx": 1.0}}).count()
    split = spark.createDataFrame([(1, "a b c", "en", "web"), (2, "d e", "fr", "book")], "doc_id long, text string, lang string, source string")
    clash = {"lang": {"en": 1.0}, "source": {"book": 1.0}}
    assert not mix_sources(split, targets=clash).count()
    with pytest.raises(ValueError, match="cannot be met together"):
        mix_sources(split, targets=clash, strict=True)
    assert mix_sources(split, targets={"lang": {"en": 1.0}}, fraction=0.9).select("doc_id").first()[0] == 1
    names = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"), F.col("id").cast("string").alias("source"))
    assert mix_sources(names, fraction=1.0).count() == 30_000  # as many levels as there are


def test_importance_keeps_clean_documents(spark, sf_dir, odd):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet".replace("sf0.001", "sf0.01")) for t in ("documents", "labels"))
    kept = importance_resample(docs, labels)
    truth = kept.join(labels, "doc_id").groupBy("quality").count().collect()
    whole = dict(labels.groupBy("quality").count().collect())
    kept_by = {r["quality"]: r["count"] for r in truth}
    assert kept_by[1] >= 0.97 * whole[1] and kept_by.get(0, 0) <= 0.15 * whole[0]
    top = importance_resample(docs, labels, k=37, temperature=5.0)
    assert top.count() == 37 and set(top.columns) == {*docs.columns, "score"}
    assert plain(top.select("doc_id")) == plain(importance_resample(docs, labels, k=37, temperature=5.0).select("doc_id"))
    assert importance_resample(docs, labels.limit(0)).count() == docs.count()
    marks = spark.createDataFrame([(5, 1, 0), (9, 0, 0), (9, 0, 0), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    assert importance_resample(odd, marks, k=3).count() == 3 and importance_resample(odd, marks, k=99).count() == odd.count() and not importance_resample(odd.limit(0), marks).count()


def test_gumbel_keys_follow_the_weights(spark):
    """Over many seeds, each document is first as often as its weight says, and the first two follow the weights without it."""
    from tickloom.llm.importance import gumbel_key

    scores, n = {1: 0.0, 2: 1.0, 3: 2.0, 4: 2.5, 5: -1.0}, 6000
    docs = spark.createDataFrame(list(scores.items()), "doc_id long, score double")
    keyed = docs.crossJoin(spark.range(n).withColumnRenamed("id", "seed")).withColumn("key", gumbel_key(F.col("score"), 0.8, F.col("seed")))
    top = keyed.groupBy("seed").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("key", "doc_id")))), 1, 2).alias("t"))
    pairs = [tuple(x.doc_id for x in r.t) for r in top.collect()]
    w = {d: np.exp(x / 0.8) for d, x in scores.items()}
    whole = sum(w.values())
    for d in scores:
        share = sum(p[0] == d for p in pairs) / n
        assert abs(share - w[d] / whole) < 4 * (w[d] / whole / n) ** 0.5 + 1e-3
        for e in scores:
            if e != d:
                chance = w[d] / whole * w[e] / (whole - w[d])
                assert abs(sum(p == (d, e) for p in pairs) / n - chance) < 4 * (chance / n) ** 0.5 + 1e-3


def test_row_ids_hold_on_shuffled_input(spark, odd, sf_dir):
    """Frames that are no plain scan are written once: rows keep their ids, and results those of the table."""
    once = with_row_id(odd.repartition(5))
    assert {(r._row, r.text) for r in once.collect()} == {(r._row, r.text) for r in once.repartition(2).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60")
    shuffled = docs.repartition(4, F.rand(3))
    for f in (lambda d: dedup_substrings(d).select("doc_id", "kept_text"), lambda d: dedup_lines(d).select("doc_id", "text")):
        assert plain(f(docs)) == plain(f(shuffled))


def test_row_ids_tell_repeats_apart(spark, odd):
    assert with_row_id(odd).select("_row").distinct().count() == odd.count()


def brute_quality(docs, labels):
    """The quality stage the plain way: counts in dictionaries, all keys sorted."""
    import pyarrow as pa
    import xxhash

    from tickloom.llm.importance import best_threshold, features

    buckets, state = 16_384, dict(labels)
    grams = {d: features(pa.RecordBatch.from_pydict({"text": [t]}), buckets)[1].tolist() for d, t in docs}
    raw, target = np.ones(buckets), np.ones(buckets)
    for d, g in grams.items():
        np.add.at(raw, g, 1)
        if state.get(d) == (1, 0):
            np.add.at(target, g, 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    score = {d: ratio[g].sum() / max(len(g), 1) ** 0.5 for d, g in grams.items()}
    known = [d for d in sorted(score) if d in state]
    threshold = best_threshold(np.array([score[d] for d in known]), np.array([state[d] == (1, 0) for d in known]), np.array([state[d][0] == 0 for d in known]), 3.0)

    def key(d):
        h = xxhash.xxh64_intdigest(int(42).to_bytes(4, "little"), xxhash.xxh64_intdigest(int(d).to_bytes(8, "little"), 42))
        return score[d] / 0.02 - np.log(-np.log(((h >> 11) + 0.5) / (1 << 53)))

    k = sum(v >= threshold for v in score.values())
    return set(sorted(score, key=lambda d: (-key(d), d))[:k])


def brute_mix(docs, taken):
    """The ids that the mix stage takes by brute force; those within 0.02 of their probability, where fitting ends early, as they were taken."""
    import xxhash
    from tickloom.llm.mixing import topic_of

    rows = docs.select("doc_id", "source", "lang", topic_of(F.col("text")).alias("topic"), "text").collect()
    tokens = {}
    for r in rows:
        tokens[r.source, r.lang, r.topic] = tokens.get((r.source, r.lang, r.topic), 0) + len((r.text or "").split())
    shares = [{} for _ in range(3)]
    for c, t in tokens.items():
        for d in range(3):
            shares[d][c[d]] = shares[d].get(c[d], 0) + t
    p, _ = brute.mixing(tokens, [{x: t**0.5 for x, t in s.items()} for s in shares], 0.8)
    out = set()
    for r in rows:
        h = xxhash.xxh64_intdigest(int(42).to_bytes(4, "little"), xxhash.xxh64_intdigest(int(r.doc_id).to_bytes(8, "little"), 42))
        odds = p[r.source, r.lang, r.topic] if (r.text or "").split() or tokens[r.source, r.lang, r.topic] else 1.0
        unit = (h >> 11) / (1 << 53)
        if unit < odds - 0.02 or (unit < odds + 0.02 and r.doc_id in taken):
            out.add(r.doc_id)
    return out


def test_pipeline_stages_take_odd_and_empty_tables(spark, sf_dir, odd):
    import corpus_pipeline as P

    whole = odd.unionByName(odd.limit(1).withColumn("source", F.lit(None).cast("string")))
    for docs in (whole, whole.limit(0), whole.filter("doc_id = 4")):
        for name, stage in P.STAGES:
            n = docs.count()
            docs = P.materialize(stage(spark, docs, sf_dir))
            assert name == "pack" or (docs.columns == P.COLUMNS and docs.count() <= n)
        assert docs.filter("offset < 0 OR length < 1").isEmpty()


def test_pipeline_stages_match_brute_force(spark, sf_dir):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "mix", "pack"]
    held = {"documents": docs}
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, sf_dir))
        held[name] = docs
    rows = {n: [tuple(r) for r in d.select("doc_id", "text").collect()] for n, d in held.items() if n != "pack"}
    assert all(held[n].columns == P.COLUMNS for n in rows)
    labels = [(r.doc_id, (r.quality, r.toxic)) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    from tickloom.llm.importance import toxic_words

    words = set(toxic_words(held["documents"], spark.read.parquet(f"{sf_dir}/labels.parquet")))
    clean = {d for d, t in rows["documents"] if not words & set(brute.normalised(t or "").split(" "))}
    assert {d for d, _ in rows["quality"]} == brute_quality(rows["documents"], labels) & clean
    assert set(rows["line_dedup"]) == brute.fuzzy_lines(rows["quality"])
    assert {d for d, _ in rows["near_dedup"]} == similar_keepers(rows["line_dedup"])
    assert set(rows["mix"]) == {x for x in rows["near_dedup"] if x[0] in brute_mix(held["near_dedup"], {d for d, _ in rows["mix"]})}
    packed = held["pack"].collect()
    coder = Tokenizer.from_file(Q.tokenizer_files()[0])
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed} == brute.pieces(rows["mix"], lambda t: coder.encode(t, add_special_tokens=False).ids)
    check_sequences(packed, 1024)
