"""Bars on the minute clock past 2025-01-01 (event 527,040) and past 2026-01-01 (event 1,052,640)."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators import labels, resample
from tickloom.plans.catalog import QUERIES
from tickloom.plans.oracles import ORACLE_SQL

STARTS = (526_990, 1_052_610)


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('late')}"
    ids = spark.range(*[STARTS[0], STARTS[0] + 400]).unionByName(spark.range(STARTS[1], STARTS[1] + 400))
    rows = ids.select(F.col("id").alias("event_id"), (F.col("id") % 50).alias("user_id"), F.lit("view").alias("event_type"), (F.pmod(F.col("id") * 7919, F.lit(101)) * 1.5).alias("value"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"))
    rows.coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["label_h15", "resample_3min", "label_all_horizons"])
def test_late_bars_match_sql(spark, late, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{late}/events.parquet/*.parquet')")
    got, want = QUERIES[name](spark, late).toPandas(), con.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want) > 0
    assert [c for c in columns if (got[c].astype(str).sort_values().tolist() != want[c].astype(str).sort_values().tolist()) and got[c].dtype.kind != "f"] == []


def test_late_windows_and_paths(spark, late):
    from tickloom.sources.events import events, minute_clock

    bars = minute_clock(events(spark, late))
    assert bars.filter("ingested_at_utc < timestamp_close_utc").count() == 0
    assert resample.resample(bars, "3min").filter("timestamp_open_utc >= '2026-01-01'").count() > 0
    asked = bars.select("instrument", "source", F.col("timestamp_open_utc").alias("prediction_time_utc"))
    assert labels.build_labels(bars, asked).filter("label_end_time_utc >= '2026-01-01'").count() > 0
