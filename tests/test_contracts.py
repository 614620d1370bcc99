import pytest

from tickloom.operators import benchmark, contracts


def test_clean_candidates_pass_and_broken_ones_are_named(spark):
    rows = spark.sql("SELECT 'x' AS instrument, 's' AS source, TIMESTAMP '2024-01-01 00:03:00' AS prediction_time_utc")
    contracts.require_clean(contracts.candidate_violations(rows), "candidates")
    contracts.require_clean(contracts.candidate_violations(rows.limit(0)), "candidates")
    with pytest.raises(ValueError, match="n_repeated"):
        contracts.require_clean(contracts.candidate_violations(rows.unionByName(rows)), "candidates")
    off = spark.sql("SELECT 'x' AS instrument, ' ' AS source, TIMESTAMP '2024-01-01 00:03:00.000001' AS prediction_time_utc")
    found = contracts.candidate_violations(off).first()
    assert (found.n_unnamed, found.n_off_grid) == (1, 1)


def test_features_must_be_allowed_and_named_once():
    assert contracts.require_allowed(["a"], ["a", "b"]) == ["a"]
    for names in ([], ["a", "a"], ["c"]):
        with pytest.raises(ValueError):
            contracts.require_allowed(names, ["a", "b"])


def test_unseen_classes_count_as_zero(spark):
    got = {r.target_class: (r.n, r.prior, r.mean_return_bps) for r in benchmark.class_priors(spark.sql("SELECT 'up' AS target_class, 2.0D AS arithmetic_return_bps")).collect()}
    assert got == {"down": (0, 0.0, 0.0), "neutral": (0, 0.0, 0.0), "up": (1, 1.0, 2.0)}


def test_selection_prefers_no_weights_then_c_near_one(spark):
    rows = spark.sql("SELECT * FROM VALUES (0.01D, false, 0.5D, 1.0D), (10D, false, 0.5D, 1.0D), (1D, true, 0.5D, 1.0D), (0.1D, false, 0.5D, 1.0D) AS t(c, weighted, macro_f1, log_loss)")
    assert benchmark.selected_candidate(rows).first().c == 0.1


def test_ablation_sets_grow(spark):
    sets = benchmark.variants(["a"], ["b"], ["c"], ["d"], ["e"])
    assert [len(v) for v in sets.values()] == [1, 2, 3, 4, 5]
    rows = spark.sql("SELECT 1 AS a, 1 AS b, CAST(NULL AS INT) AS c, 1 AS d, 1 AS e")
    assert [r.n_whole for r in benchmark.variant_support(rows, sets).collect()] == [1, 1, 0, 0, 0]
