"""Tables written once in the folder that driver and executors share, for plans that read a costly result more than once."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir; where that is unset, under a folder of this machine on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file:///tmp/checkpoints/tickloom"
    return f"{root.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table of files: computed once, read as often as plans name it, and safe from lost executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard_all(spark: SparkSession) -> None:
    """Delete all tables that this application wrote here."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
