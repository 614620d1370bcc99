"""Every catalog query against its DuckDB twin on the smallest tables."""

import duckdb
import pytest

from tickloom.plans.catalog import QUERIES
from tickloom.plans.oracles import ORACLE_SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    return c


@pytest.fixture(scope="module", autouse=True)
def shared_bases(spark):
    """Minute bars and the model table are made once for all queries of the module; the first query that asks tests how."""
    from tickloom.plans import catalog, streams
    from tickloom.scratch import written
    from tickloom.session import in_utc

    made = {}

    def once(name, plain):
        def run(spark, d):
            if (name, d) not in made:
                made[name, d] = written(plain(in_utc(spark), d))
            return made[name, d]

        return run

    with pytest.MonkeyPatch.context() as patch:
        for name in ("clocks", "predictions"):
            kept = once(name, getattr(catalog, name))
            for module in (catalog, streams):
                patch.setattr(module, name, kept)
        yield


FITTED = {"model_logistic", "model_ridge"}  # no SQL for an optimizer
NESTED = {"nested_selection", "promotion_report", "model_boosted"}  # against plain loops in test_walkforward


def test_every_query_has_a_twin():
    assert QUERIES.keys() == ORACLE_SQL.keys() | FITTED | NESTED


@pytest.mark.parametrize("name", sorted(FITTED))
def test_fitted(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == 2 and all(0.2 < r.accuracy <= 1 and 0 <= r.brier <= 2 for r in rows)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(spark, con, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (sorted(map(tuple, df[columns].astype(str).to_numpy().tolist())) for df in (got, want))
    assert a == b


@pytest.mark.parametrize("name", ["nonoverlap_trades", "daily_quality_classes", "regime_features", "feature_variants", "ordered_digest", "label_all_horizons"])
def test_query_with_generated_code(spark, con, sf_dir, name):
    """The same as production compiles it."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    try:
        test_query(spark, con, sf_dir, name)
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "false")
