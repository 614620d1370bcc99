"""The operators over their whole tables with production parameters: one query each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.audit import audit_filters
from tickloom.llm.common import scratch_root
from tickloom.llm.importance import importance_resample, without_toxic
from tickloom.llm.linededup import dedup_lines
from tickloom.llm.mixing import mix_sources
from tickloom.llm.packing import pack_documents
from tickloom.llm.pivots import top_products
from tickloom.llm.runs import collapse_runs, longest_run, planted_periods
from tickloom.llm.secrets import scan_secrets
from tickloom.llm.sharding import shard_documents
from tickloom.llm.simhash import near_duplicates
from tickloom.llm.substring import dedup_substrings
from tickloom.llm.vptree import nearest_vectors
from tickloom.llm.warc import assemble, read_records, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_warc_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write_warc(table(spark, sf_dir, "pages"), f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}", min_revisit_bytes=0)
    r = F.col("response")
    return assemble(read_records(spark, archive)).select("page_id", r.payload_bytes.alias("payload_bytes"), r.payload_digest.alias("payload_digest"), r.type.alias("record_type"), r.refers_to_page.alias("refers_to"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "tokens", "p")


def op3_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return without_toxic(importance_resample(docs, labels), labels).select("doc_id", "score")


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 8).withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op5_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, budget=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer, ranks = tokenizer_files()
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer, ranks, capacity=1024, end_id=2, keep_ids=False)


def op7_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_substrings(table(spark, sf_dir, "documents"), window=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op9_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op11_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", planted_periods(F.col("doc_id"), F.col("text")))
    found = collapse_runs(docs.select("doc_id", "text"), least=12).withColumn("best", longest_run(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
                        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s.base)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    number = lambda kind: F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc_assembly, op2_mix_sources, op3_importance_resample, op4_minimax_shards, op5_simhash_trie, op6_best_two_fit, op7_seed_and_extend, op8_vantage_trees, op9_pivot_topk, op10_fuzzy_lines, op11_lyndon_runs, op12_filter_audit, op13_secret_scan)
}

ORACLE_SQL: dict[str, str] = {
    # Base32 of SHA-1 in DuckDB: the hex digits as bits, five at a time.
    "op1_warc_assembly": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h),
        d AS (SELECT h, first_id, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
              substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, CAST(1 + 5 * i AS INT), 5))::BIGINT >> s) & 31 AS INT), 1)), '')), '') AS digest FROM f)
        SELECT page_id, payload_bytes, digest AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM p JOIN d USING (h)
    """,
    "op7_seed_and_extend": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        x AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 33), lambda i: {'i': i, 'h': md5(array_to_string(w[i:i+34], ' '))})) AS u FROM d WHERE len(w) >= 35),
        r AS (SELECT u.h AS h FROM x GROUP BY u.h HAVING count(*) > 1),
        g AS (SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT doc_id, unnest(range(x.u.i, x.u.i + 35)) AS k FROM x SEMI JOIN r ON x.u.h = r.h) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id)
    """,
    "op9_pivot_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """,
    # Runs as stretches of equal 6-word windows at one distance: a run of 12 words and two periods holds one at least.
    "op11_lyndon_runs": r"""
        WITH c AS (SELECT list(crc ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(CAST(k AS UBIGINT), CAST(range(8) AS UBIGINT[])), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS crc FROM range(256) r(k))),
        h0 AS (SELECT doc_id, text, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda z: CAST(ascii(z) AS UBIGINT))),
                lambda x, y: xor(x >> 8, c.t[1 + CAST(xor(x, y) & 255 AS INT)])), 4294967295) AS h FROM documents, c),
        w0 AS (SELECT doc_id, CAST(h AS BIGINT) AS h, CAST(h // 10 AS BIGINT) AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM h0),
        w1 AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM w0),
        w2 AS (SELECT *, 1 + (len(w) - a) // (3 + g % 8) AS p FROM w1),
        d AS (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM w2),
        x AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 4), lambda i: {'i': i - 1, 'g': array_to_string(w[i:i+5], ' ')})) AS u FROM d WHERE len(w) >= 12),
        m AS (SELECT a.doc_id, a.u.i AS i, b.u.i - a.u.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.u.g = b.u.g AND a.u.i < b.u.i),
        s AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island),
        r AS (SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(min(q) AS BIGINT) AS period FROM s WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length),
        gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS k FROM r) GROUP BY doc_id),
        per AS (SELECT doc_id, count(*) AS n_runs, arg_min({'s': start, 'l': length, 'p': period}, [-length, start, period]) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
               sha256(array_to_string(CASE WHEN ks IS NULL THEN w ELSE list_filter(w, lambda y, k: NOT list_contains(ks, k - 1)) END, ' ')) AS collapsed_sha256
        FROM d LEFT JOIN per ON d.doc_id = per.doc_id LEFT JOIN gone ON d.doc_id = gone.doc_id
    """,
    "op12_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                || CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                || CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
        h AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
        e AS (SELECT unnest(string_split('ABCDE', '')) AS x),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM e a, e b, e c, e d, e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS own, filter_order[:step - 1] AS earlier FROM o, range(1, 6) r(step)),
        k AS (SELECT part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) AS now, len(translate(fails, earlier, '')) < len(fails) AS gone FROM h, s),
        z AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT now THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND now THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN gone AND now THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN NOT gone AND now THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND now THEN toxic ELSE 0 END) AS toxic_lost FROM k GROUP BY ALL)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM z
    """,
}


def _secret_sql() -> str:
    """Places of the matches from the pieces between them, one branch a pattern."""
    head = """(?i:password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?[A-Za-z0-9+/_.=-]"""
    patterns = [
        ("assign", True, head + "+"), ("assign", False, head + "{12,}"), ("access", True, "AKIA[A-Z0-9]{14,}"), ("hex", True, "[0-9a-f]{16,}"),
        ("pem", False, "-----BEGIN\\x20(?:[A-Z]+\\x20)*PRIVATE\\x20KEY-----"), ("slack", False, "xox[abprs]-[A-Za-z0-9-]{10,}"),
    ]
    kinds = list(dict.fromkeys(kind for kind, _, _ in patterns))
    branch = "SELECT doc_id, {k} AS k, '{kind}' AS kind, {base} AS base, regexp_extract_all(text, '{p}') AS f, regexp_split_to_array(text, '{p}') AS g FROM documents WHERE regexp_matches(text, '{p}')"
    found = " UNION ALL ".join(branch.format(k=kinds.index(kind), kind=kind, base=base, p=p) for kind, base, p in patterns)
    return f"""
        WITH m AS ({found}),
        u AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m),
        s AS (SELECT doc_id, k, kind, base, f[i] AS match, CAST(list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: len(x))), 0) AS BIGINT) AS start FROM u),
        a AS (SELECT doc_id, k, kind, start, start + len(match) AS stop, bool_or(base) AS base FROM s WHERE k > 0 OR regexp_full_match(match, '{patterns[1][2]}') GROUP BY ALL),
        b AS (SELECT *, kind || ':' || start || ':' || stop AS said FROM a)
        SELECT documents.doc_id, count(*) FILTER (base AND k = 0) AS n_assign, count(*) FILTER (base AND k = 1) AS n_access, count(*) FILTER (base AND k = 2) AS n_hex,
               sha256(coalesce(string_agg(said, ',' ORDER BY start, k, stop) FILTER (base), '')) AS base_sha256, coalesce(string_agg(said, ',' ORDER BY start, k, stop), '') AS spans
        FROM documents LEFT JOIN b ON documents.doc_id = b.doc_id GROUP BY documents.doc_id
    """


ORACLE_SQL["op13_secret_scan"] = _secret_sql()
