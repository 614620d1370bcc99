"""WARC archives: write captures as request, response or revisit, and metadata records; read them back and assemble them.

Archives are text files that Spark writes and reads in parallel. Every record names its archive's warcinfo record in the
first header line; that line holds a random id, so no payload can contain it, and it serves as the record separator.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import ROW, skew_join, with_row_id

EOL = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Archive(NamedTuple):
    path: str
    warcinfo: str

    @property
    def head(self) -> str:
        return f"WARC/1.1{EOL}WARC-Warcinfo-ID: <urn:uuid:{self.warcinfo}>{EOL}"


def base32(sha1: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 given in hex: 40 bits, so eight digits, at a time."""
    digits = [F.lpad(F.conv(F.substring(sha1, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind), key))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(archive: Archive, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record but for its last line feed, which the text writer adds. Null header values leave the line out."""
    lines = [F.concat(F.lit(f"{k}: "), v, F.lit(EOL)) for k, v in [*headers, ("Content-Length", F.octet_length(block).cast("string"))]]
    return F.concat(F.lit(archive.head), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(EOL), block, F.lit("\r\n\r"))


def capture_rows(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Pages with payload, payload_digest, and the key of the page each one repeats (null: it is a response).

    Of pages with equal payloads of at least min_revisit_bytes bytes, that with the smallest page_id (null comes last,
    then scan order) is the response. Payload digests are grouped with partial sums, and only those that repeat are joined
    back, with splittable keys: a payload on a third of all pages does no harm, and payloads are not sorted.
    """
    full = with_row_id(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))).withColumn("sha1", F.sha1("payload"))
    key = F.concat_ws(":", F.col("page_id"), F.col(ROW))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", ROW)
    large = full.filter(F.octet_length("payload") >= min_revisit_bytes).select("sha1", order.alias("at"))
    first = large.groupBy("sha1").agg(F.min("at").alias("at"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.xxhash64("sha1").alias("h"), F.col("sha1").alias("same"), F.concat_ws(":", F.col("at.page_id"), F.col(f"at.{ROW}")).alias("first"))
    joined = skew_join(full.withColumn("h", F.xxhash64("sha1")), first.hint("shuffle_hash"), ["h"], "left")
    repeats = (F.col("same") == F.col("sha1")) & (F.octet_length("payload") >= min_revisit_bytes) & (F.col("first") != key)
    return joined.select(key.alias("key"), "page_id", "url", "payload", base32(F.col("sha1")).alias("digest"), F.when(repeats, F.col("first")).alias("refers"))


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: str = "BEST_SPEED") -> Archive:
    """Write page_id, url, html as gzipped WARC files under path: three records a page, concurrent to one another.

    Null html is an empty payload, a null url an empty one; spaces and control characters in a url become %20. Other
    columns are not used. An empty table gives an archive of one warcinfo record. level: of gzip.
    """
    archive = Archive(path, str(uuid.uuid4()))
    rows = capture_rows(pages, min_revisit_bytes)
    key, payload, revisit = F.col("key"), F.col("payload"), F.col("refers").isNotNull()
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    request, response, metadata = (_urn(k, key) for k in ("request", "response", "metadata"))
    common = [("WARC-Target-URI", uri), ("WARC-Date", F.lit(date))]
    asked = F.concat(F.lit("GET "), F.concat(F.lit("/"), F.regexp_extract(uri, "^[a-zA-Z]+://[^/?#]*/?([^#]*)", 1)), F.lit(f" HTTP/1.1{EOL}Host: "), F.regexp_extract(uri, "^[a-zA-Z]+://([^/?#]*)", 1), F.lit(EOL * 2))
    answer = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(EOL * 2), F.when(revisit, "").otherwise(payload))
    records = F.array(
        _record(archive, [("WARC-Type", F.lit("request")), ("WARC-Record-ID", request), ("WARC-Concurrent-To", response), *common, ("Content-Type", F.lit("application/http;msgtype=request"))], asked),
        _record(archive, [("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", response), ("WARC-Refers-To", _urn("response", F.col("refers"))), ("WARC-Profile", F.when(revisit, PROFILE)), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), *common, ("Content-Type", F.lit("application/http;msgtype=response"))], answer),
        _record(archive, [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", metadata), ("WARC-Concurrent-To", response), *common, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(EOL))),
    )
    info = pages.sparkSession.range(1).select(_record(archive, [("WARC-Type", F.lit("warcinfo")), ("WARC-Record-ID", F.lit(f"<urn:uuid:{archive.warcinfo}>")), ("WARC-Date", F.lit(date)), ("Content-Type", F.lit("application/warc-fields"))], F.lit(f"format: WARC File Format 1.1{EOL}")).alias("value"))
    rows.select(F.explode(records).alias("value")).unionByName(info).write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", level).text(path)
    return archive


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """All records: type, record_id, concurrent_to, refers_to, target_uri, payload_digest, block. A record whose block
    hasn't the bytes that Content-Length states fails the job."""
    raw = spark.read.option("lineSep", archive.head).text(archive.path).filter("value <> ''")
    head = F.substring_index("value", EOL * 2, 1)
    cut = raw.withColumn("head", head).withColumn("block", F.expr("substring(value, length(head) + 5, length(value) - length(head) - 8)")).drop("value")
    field = lambda k: F.regexp_extract("head", rf"(?m)^{k}: ([^\r\n]*)", 1)
    whole = F.octet_length("block") == field("Content-Length").cast("int")
    return cut.select(
        field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("record_id"), field("WARC-Concurrent-To").alias("concurrent_to"),
        field("WARC-Refers-To").alias("refers_to"), field("WARC-Target-URI").alias("target_uri"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        F.when(whole, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("broken record "), field("WARC-Record-ID")))).alias("block"),
    )


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: its response or revisit with the request and the metadata concurrent to it.

    Captures without a request or metadata record keep null there. page_id comes from the metadata record's fields, and
    refers_to_page from the capture that a revisit refers to. Digest and length of each response's payload are taken anew from
    what was read, and headers that state others fail the job; a revisit, which has no payload, keeps what its headers state.
    """
    http_head = F.substring_index("block", EOL * 2, 1)
    states = F.regexp_extract(http_head, r"(?m)^Content-Length: (\d+)", 1).cast("long")
    heads = records.filter("type IN ('response', 'revisit')").select("record_id", "type", "refers_to", "target_uri", F.col("payload_digest").alias("stated"), states.alias("stated_bytes"), F.expr("substring(block, length(substring_index(block, '\\r\\n\\r\\n', 1)) + 5)").alias("payload"))
    read, size = base32(F.sha1("payload")), F.octet_length("payload").cast("long")
    whole = (F.col("type") == "revisit") | ((F.col("stated") == read) & (F.col("stated_bytes") == size))
    responses = heads.select("record_id", "type", "refers_to", "target_uri", "payload", F.col("stated_bytes").alias("payload_bytes"), F.when(whole, F.col("stated")).otherwise(F.raise_error(F.concat(F.lit("digest differs in "), F.col("record_id")))).alias("payload_digest"))
    asked = records.filter("type = 'request'").select(F.col("concurrent_to").alias("record_id"), F.col("record_id").alias("request_id"), F.regexp_extract("block", r"^(\S+) ", 1).alias("method"))
    noted = records.filter("type = 'metadata'").select(F.col("concurrent_to").alias("record_id"), F.col("record_id").alias("metadata_id"), F.regexp_extract("block", r"page-id: (-?\d+)", 1).try_cast("long").alias("page_id"))
    flat = responses.join(noted, "record_id", "left").join(asked, "record_id", "left")
    targets = noted.select(F.xxhash64("record_id").alias("r"), F.col("record_id").alias("target"), F.col("page_id").alias("refers_to_page"))
    linked = skew_join(flat.withColumn("r", F.when(F.col("type") == "revisit", F.xxhash64("refers_to"))), targets, ["r"], "left").filter("target IS NULL OR target = refers_to")
    return linked.select(
        "page_id", "target_uri",
        F.struct(F.col("request_id").alias("record_id"), "method").alias("request"),
        F.struct("record_id", "type", "payload", "payload_bytes", "payload_digest", F.when(F.col("type") == "revisit", F.col("refers_to_page")).alias("refers_to_page")).alias("response"),
        F.struct(F.col("metadata_id").alias("record_id"), "page_id").alias("metadata"),
    )
