"""Session settings that the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tickloom", **conf: str) -> SparkSession:
    """A session in UTC with ANSI arithmetic and adaptive execution; conf overrides (underscores for dots)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def in_utc(spark: SparkSession) -> SparkSession:
    """Timestamps are instants in UTC; plans built after this call read and show them so."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
