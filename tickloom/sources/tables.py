"""Tables with lineage: partitioned writes, manifests whose version is their content, and reads that check them."""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(value: Any) -> str:
    """JSON with sorted keys and no NaN: equal content, equal text."""

    def check(v: Any) -> None:
        if isinstance(v, float) and not math.isfinite(v):
            raise ValueError("not a finite number")
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, (list, tuple)) else ():
            check(x)

    check(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def content_version(value: Any) -> str:
    return "sha256:" + hashlib.sha256(canonical(value).encode()).hexdigest()


def table_digest(df: DataFrame) -> dict[str, Any]:
    """Rows, and an order-free hash of them, in one distributed pass."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    n, mixed, total = df.agg(F.count("*"), F.bit_xor(row), F.sum(row.cast("decimal(38,0)"))).first()
    return {"rows": n, "xor": mixed or 0, "sum": str(total or 0)}


def write_bars(df: DataFrame, path: str, year_of: str = "timestamp_open_utc", mode: str = "errorifexists") -> None:
    """zstd Parquet partitioned by UTC year; an existing table is left alone unless mode says otherwise."""
    df.withColumn("utc_year", F.year(year_of)).write.mode(mode).option("compression", "zstd").partitionBy("utc_year").parquet(path)


def manifest(df: DataFrame, layer: str, inputs: dict[str, str], params: dict[str, Any], time: str = "timestamp_open_utc") -> dict[str, Any]:
    """What the table is made of and holds; the version leaves the creation time out."""
    first, last = df.agg(F.min(time), F.max(time)).first()
    body = {"layer": layer, "inputs": inputs, "params": params, "schema": json.loads(df.schema.json()), "first": str(first), "last": str(last), **table_digest(df)}
    return body | {"version": content_version(body)}


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file through Spark's file systems, whole or not at all."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = to.getFileSystem(conf)
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(to, False)
    if not fs.rename(part, to):
        raise OSError(f"{path} could not be written")


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def publish(df: DataFrame, path: str, layer: str, inputs: dict[str, str], params: dict[str, Any]) -> dict[str, Any]:
    """Write the table and then, last, its manifest: a table without one is unfinished."""
    write_bars(df, f"{path}/table")
    found = manifest(df.sparkSession.read.parquet(f"{path}/table"), layer, inputs, params)
    write_text(df.sparkSession, f"{path}/manifest.json", canonical(found))
    return found


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The table, if it still holds what its manifest says."""
    said = json.loads(read_text(spark, f"{path}/manifest.json"))
    df = spark.read.parquet(f"{path}/table")
    if content_version({k: v for k, v in said.items() if k != "version"}) != said["version"]:
        raise ValueError(f"{path}: the manifest was changed")
    if (now := table_digest(df)) != {k: said[k] for k in now}:
        raise ValueError(f"{path}: the table is not what its manifest says")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """A small result, such as metrics by hour, as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A small result as a Markdown table; more rows than the limit are an error, not cut off."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else f"{c:.4f}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), line(["-"] * len(df.columns)), *[line(r) for r in rows]]) + "\n"
