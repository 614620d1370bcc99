"""Raw minute bars: delimited members of ZIP archives, read and checked as Spark jobs; providers and incremental updates."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.schema import later

LINE = r"^(\d{8} \d{4}00);([^;]+);([^;]+);([^;]+);([^;]+);([^;]+)$"
MAX_MEMBER_BYTES = 256 * 1024 * 1024


def _members(pattern: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    wanted = re.compile(pattern, re.IGNORECASE)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = sorted((i for i in z.infolist() if wanted.search(i.filename)), key=lambda i: i.filename.lower())
                    if not names:
                        raise ValueError(f"{path}: no member matches {pattern}")
                    for info in names:
                        if info.flag_bits & 1 or info.file_size > MAX_MEMBER_BYTES:
                            raise ValueError(f"{path}: {info.filename} is encrypted or too large")
                        with z.open(info) as f:  # reading checks the CRC
                            for lines in iter(lambda f=f: f.readlines(4_000_000), []):
                                text = [x.decode("utf-8-sig").rstrip("\r\n") for x in lines]
                                yield pd.DataFrame({"archive": path, "member": info.filename, "line": [t for t in text if t]})

    return run


def scan_archives(spark: SparkSession, path: str, pattern: str = r"DAT_ASCII_.*_M1_.*\.csv$") -> DataFrame:
    """(archive, member, line, archive_sha256): lines of the members that match, an archive a task, streamed."""
    files = spark.read.format("binaryFile").load(path)
    hashes = files.select(F.col("path").alias("archive"), F.sha2("content", 256).alias("archive_sha256"))
    return files.select("path", "content").mapInPandas(_members(pattern), "archive string, member string, line string").join(hashes, "archive")


def parse_lines(lines: DataFrame, offset_hours: int = -5, instrument: str = "XAU_USD", source: str = "histdata") -> DataFrame:
    """Bars of lines `YYYYMMDD HHMM00;open;high;low;close;volume` on a fixed clock, with well_formed; what is not stays, so
    that the caller can count it."""
    part = lambda i: F.regexp_extract("line", LINE, i)
    ok = F.col("line").rlike(LINE)
    opens = later(F.try_to_timestamp(F.when(ok, part(1)), F.lit("yyyyMMdd HHmmss")), -60 * offset_hours)
    prices = {f"bid_{n}": F.when(ok, part(i + 2)).try_cast("double") for i, n in enumerate(("open", "high", "low", "close"))}
    out = lines.withColumns({"timestamp_open_utc": opens} | prices | {"volume": F.when(ok, part(6)).try_cast("double")})
    whole = F.col("timestamp_open_utc").isNotNull()
    for c in [*prices, "volume"]:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return out.withColumns({
        "timestamp_close_utc": later(F.col("timestamp_open_utc"), 1), "instrument": F.lit(instrument), "source": F.lit(source), "timeframe": F.lit("1min"), "is_complete": F.lit(True), "volume_reliable": F.lit(False),
        "raw_file_hash": F.col("archive_sha256") if "archive_sha256" in lines.columns else F.lit(None).cast("string"), "well_formed": whole,
    })


def ingest(spark: SparkSession, path: str, year: int, as_of: str, offset_hours: int = -5, **names: str) -> DataFrame:
    """Well-formed, once-only, closed bars of one source year; malformed lines, other years and conflicts are errors."""
    rows = parse_lines(scan_archives(spark, path), offset_hours, **names)
    other = F.year(later(F.col("timestamp_open_utc"), 60 * offset_hours)) != year
    bad, strange = rows.agg(F.count_if(~F.col("well_formed")), F.count_if(other)).first()
    if bad or strange:
        raise ValueError(f"{bad} malformed lines, {strange} outside {year}")
    prices = ["bid_open", "bid_high", "bid_low", "bid_close", "volume"]
    once = rows.dropDuplicates(["timestamp_open_utc", *prices])
    if once.groupBy("timestamp_open_utc").count().filter("count > 1").limit(1).count():
        raise ValueError("one minute with different bars")
    stamped = once.withColumns({"ingested_at_utc": F.lit(as_of).cast("timestamp"), "dataset_version": F.lit("raw")})
    return stamped.filter(F.col("timestamp_close_utc") <= F.lit(as_of).cast("timestamp")).drop("line", "well_formed")


@dataclass(frozen=True)
class Resource:
    """A span of history that a provider can deliver."""

    name: str
    start: datetime
    end: datetime


@dataclass(frozen=True)
class Capabilities:
    resolution: str = "1min"
    bid: bool = True
    ask: bool = False
    reliable_volume: bool = False


PROVIDERS: dict[str, Callable[..., object]] = {}


def register_provider(name: str, factory: Callable[..., object]) -> None:
    if name in PROVIDERS:
        raise ValueError(f"{name} is registered already")
    PROVIDERS[name] = factory


def create_provider(name: str, **settings):
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name](**settings)


def plan_update(pages: Iterator[list[Resource]], have: set[str], start: datetime, end: datetime, guard: datetime) -> list[Resource]:
    """Resources within [start, end) that are not there yet, in order. Names given twice, overlapping spans, an endless listing,
    and anything that reaches the guard are errors."""
    seen: dict[str, Resource] = {}
    for n, page in enumerate(pages):
        if n > 10_000:
            raise ValueError("the listing does not end")
        for r in page:
            if r.name in seen:
                raise ValueError(f"{r.name} is listed twice")
            seen[r.name] = r
    chosen = sorted((r for r in seen.values() if r.start >= start and r.end <= end), key=lambda r: (r.start, r.name))
    for a, b in zip(chosen, chosen[1:], strict=False):
        if b.start < a.end:
            raise ValueError(f"{a.name} and {b.name} overlap")
    if late := [r.name for r in chosen if r.end > guard]:
        raise ValueError(f"resources that reach the guard: {', '.join(late)}")
    return [r for r in chosen if r.name not in have]
