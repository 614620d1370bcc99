"""Files by content: a folder's files with their digests, held against the list that was written with them."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.tables import canonical, content_version, manifest, read_text, table_digest, write_bars, write_text

CONTENT, LIST, MANIFEST = "content", "files", "manifest.json"


class InventoryError(ValueError):
    """A folder that isn't what its manifest says."""


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as file sources name it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path below root, length, sha256) of every file that tables read: a file a row, hashed where it is read. Names that begin with _ or . are
    left out, as Spark leaves them out; an empty folder gives no rows."""
    base = qualified(spark, root).rstrip("/") + "/"
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")  # noqa: E731  one form of slashes
    name = F.substring(plain(F.col("path")), F.length(plain(F.lit(base))) + 1, F.length("path"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select(name.alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def escapes(path: str) -> Column:
    """Whether a listed path leads out of its folder, or isn't a plain relative one."""
    p = F.col(path)
    return F.coalesce((p == "") | p.startswith("/") | p.contains("\\") | p.contains(":") | F.exists(F.split(p, "/"), lambda x: x.isin("", ".", "..")), F.lit(True))


def compared(listed: DataFrame, there: DataFrame) -> DataFrame:
    """path and status of every file that is listed or there: same, changed, missing, added, repeated (listed twice), escapes."""
    said = listed.groupBy("path").agg(F.count("*").alias("_n"), F.min("length").alias("_length"), F.min("sha256").alias("_sha256")).withColumn("path", F.coalesce("path", F.lit("")))
    both = said.join(there, "path", "full_outer")
    same = (F.col("_length") == F.col("length")) & (F.lower("_sha256") == F.col("sha256"))
    status = F.when(F.col("_n").isNull(), "added").when(escapes("path"), "escapes").when(F.col("_n") > 1, "repeated").when(F.col("length").isNull(), "missing").when(F.coalesce(same, F.lit(False)), "same")
    return both.select("path", status.otherwise("changed").alias("status"))


def seal(spark: SparkSession, path: str, body: dict[str, Any]) -> dict[str, Any]:
    """Write the list of path/content's files and then, last, the manifest: body, what the list holds, and a version that is their hash."""
    files(spark, f"{path}/{CONTENT}").write.parquet(f"{path}/{LIST}")
    said = {"body": body, "files": table_digest(spark.read.parquet(f"{path}/{LIST}"))}
    said |= {"version": content_version(said)}
    write_text(spark, f"{path}/{MANIFEST}", canonical(said))
    return said


def unsealed(spark: SparkSession, path: str) -> dict[str, Any]:
    """The manifest, once everything was checked: its version, the list, and each file. Nothing of the content is read as data before."""
    said = json.loads(read_text(spark, f"{path}/{MANIFEST}"))
    if content_version({k: v for k, v in said.items() if k != "version"}) != said.get("version"):
        raise InventoryError(f"{path}: the manifest was changed")
    listed = spark.read.parquet(f"{path}/{LIST}")
    if table_digest(listed) != said["files"]:
        raise InventoryError(f"{path}: the list of files was changed")
    require_provenance(spark, f"{path}/{CONTENT}", listed)
    return said


def publish_layer(df: DataFrame, path: str, layer: str, inputs: dict[str, str], params: dict[str, Any], time: str = "timestamp_open_utc") -> dict[str, Any]:
    """A layer of bars as files by UTC year under path/content, sealed: what it was made of, its rows, its span, its years."""
    spark = df.sparkSession
    write_bars(df, f"{path}/{CONTENT}", time)
    table = spark.read.parquet(f"{path}/{CONTENT}")
    years = [r.utc_year for r in table.select("utc_year").distinct().orderBy("utc_year").collect()]  # a few
    return seal(spark, path, manifest(table, layer, inputs, params, time) | {"years": years, "time": time})


def read_layer(spark: SparkSession, path: str, layer: str | None = None, inputs: dict[str, str] | None = None, years: list[int] | None = None, first: str | None = None, before: str | None = None) -> DataFrame:
    """A published layer, once every file is as listed and the manifest says what the caller counts on: the layer's name, the versions it was made
    of, exactly these years, no bar before `first` or from `before` on. What the manifest says of rows and span is held against the table, in
    one pass. Anything else is an InventoryError, and nothing is read as data before the files are checked."""
    body = unsealed(spark, path)["body"]
    for what, said, wanted in (("layer", body["layer"], layer), ("inputs", body["inputs"], inputs), ("years", body["years"], years)):
        if wanted is not None and said != wanted:
            raise InventoryError(f"{path}: {what} {said}, not {wanted}")
    table = spark.read.parquet(f"{path}/{CONTENT}")
    time = F.col(body["time"])
    now = table.agg(F.count("*").alias("rows"), F.min(time).alias("a"), F.max(time).alias("b"), F.count_if(F.year(time) != F.col("utc_year")).alias("strays"), F.count_if(time < F.lit(first).cast("timestamp")).alias("early"), F.count_if(time >= F.lit(before).cast("timestamp")).alias("late")).first()
    if (now.rows, str(now.a), str(now.b)) != (body["rows"], body["first"], body["last"]):
        raise InventoryError(f"{path}: {now.rows} rows from {now.a} to {now.b}, not as the manifest says")
    if now.strays or now.early or now.late:
        raise InventoryError(f"{path}: {now.strays} bars in another year's files, {now.early} before {first}, {now.late} from {before} on")
    return table


def require_provenance(spark: SparkSession, root: str, provenance: DataFrame) -> None:
    """Raise unless the files below root are exactly those of the provenance (path, length, sha256): for archives, before any is opened."""
    off = compared(provenance.select("path", "length", "sha256"), files(spark, root)).filter("status <> 'same'").orderBy("path").limit(21).collect()
    if off:
        raise InventoryError(f"{root}: " + "; ".join(f"{r.status}: {r.path}" for r in off[:20]) + (" and more" if len(off) > 20 else ""))
