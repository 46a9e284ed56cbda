"""Small cases of rules that the sf tables do not reach."""

import datetime as dt

import numpy as np
import pytest

from ledgerline.functions import columns as C
from ledgerline.functions.joins import fits
from ledgerline.functions.quantiles import kth_smallest
from ledgerline.operators import alerts, anomaly, series_models
from ledgerline.operators import forecast as FC
from ledgerline.operators.automl import _estimator


def test_ranks_of_infinite_and_huge_values(spark, monkeypatch):
    """Brackets wider than the double range, and infinite ends, still narrow to the exact value."""
    import ledgerline.functions.quantiles as Qm
    monkeypatch.setattr(Qm, "_FETCH_LIMIT", 2)
    monkeypatch.setattr(Qm, "_ACCURACY", 2)
    values = [float("-inf"), -1.7e308, -3.0, 0.0, 0.0, 5e-324, 2.0, 2.0, 1.7e308, float("inf"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert kth_smallest(df, "v", list(range(len(values)))) == dict(enumerate(values))


def test_forest_draws_full_samples_at_every_size(spark):
    for n in (300, 3000):
        df = spark.range(n).selectExpr("cast(id as double) as x")
        model = anomaly.fit_isolation_forest(df, ["x"], trees=8, seed=5)
        assert [t[4][0] for t in model["trees"]] == [256] * 8


def test_forecast_error_leaves_out_the_start_season(spark):
    y = 50 + 2.0 * np.arange(36) + np.random.default_rng(2).normal(0, 5, 36)
    table = [(dt.datetime(2020 + i // 12, i % 12 + 1, 1), float(v)) for i, v in enumerate(y)]
    got = FC.forecast(spark.createDataFrame(table, "d timestamp_ntz, v double"), "d", "v", 3, models=("Holt-Winters",))
    res, *_ = series_models.holt_winters(y[None], 3, 12)
    assert got.first()["mse"] == pytest.approx(np.mean(res[0, 12:] ** 2), rel=1e-6)


def test_broadcast_check_counts_bytes(spark):
    wide = spark.range(4).selectExpr("id", "repeat('x', 1000) as s")
    assert fits(wide, 4, 10_000) and not fits(wide, 4, 2_000) and not fits(wide, 3, 10_000)
    assert fits(wide.where("id < 0"), 4, 10)


def test_constants_that_a_type_cannot_hold(spark):
    df = spark.createDataFrame([(1, 2.0, "a")], "i int, x double, s string")
    row = C.overlay_constants(df, {"i": "many", "x": "0.5", "s": "it's \\ here"}).first()
    assert tuple(row) == (None, 0.5, "it's \\ here")


def test_newest_result_gives_the_alert(spark):
    day = dt.datetime(2026, 1, 1)
    q = spark.createDataFrame([("p", "d1", "old.csv", 50.0, day), ("p", "d2", "new.csv", 70.0, day + dt.timedelta(1))],
                              "project_id string, dataset_id string, filename string, score double, "
                              "created_at timestamp_ntz")
    [hit] = alerts.scan_alerts(quality=q).collect()
    assert (hit.severity, hit.source_id) == ("HIGH", "d2")


def test_report_recommendations(spark):
    day = dt.datetime(2026, 1, 1)
    q = spark.createDataFrame([("p", "d1", 86.0, day), ("q", "d2", 60.0, day)],
                              "project_id string, dataset_id string, score double, created_at timestamp_ntz")
    m = spark.createDataFrame([("p", "B", 0.9, None), ("p", "A", 0.9, None)],
                              "project_id string, model_name string, accuracy double, r2_score double")
    f = spark.createDataFrame([("p", 1, 1.0), ("p", 2, 3.0), ("p", 2, 5.0)],
                              "project_id string, step int, forecast double")
    a = spark.createDataFrame([("p", "r1", 3, 4.0, day), ("q", "r2", 20, 12.0, day)],
                              "project_id string, run_id string, anomaly_count bigint, anomaly_percentage double, "
                              "created_at timestamp_ntz")
    got = {r.project_id: r for r in alerts.report_facts(q, m, f, a).collect()}
    assert (got["p"].quality_class, got["q"].quality_class) == ("Excellent", "Fair")
    assert (got["p"].best_model, got["p"].forecast_last) == ("A", 5.0)
    assert got["p"].advice == [alerts.REPORT_ANOMALY_VERIFY % 3, *alerts.REPORT_ADVICE]
    assert got["q"].advice == [alerts.REPORT_ANOMALY_CRITICAL, *alerts.REPORT_ADVICE]


def test_boosting_of_three_classes(spark):
    from pyspark.ml.feature import VectorAssembler
    df = spark.range(60).selectExpr("cast(id % 3 as double) as label", "cast(id % 3 as double) as x")
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    est = _estimator("Gradient Boosting", "classification", 1, 3, 42)
    est.getClassifier().setMaxIter(2)
    assert est.fit(df).transform(df).where("prediction <> label").count() == 0


def test_model_fits_have_the_references_budgets_by_default():
    from ledgerline.operators.automl import Budget

    budget = Budget()
    assert (budget.trees, budget.tree_depth, budget.boosting_rounds, budget.boosting_depth) == (100, None, 100, 3)
    assert budget.net_iterations == 500 and budget.grid_depths == (5, 10, None) and budget.grid_trees == (50, 100)
    for problem in ("classification", "regression"):
        boosted = _estimator("Gradient Boosting", problem, 1, 2, 42)
        assert (boosted.getMaxIter(), boosted.getMaxDepth()) == (100, 3)
    assert _estimator("Neural Network", "classification", 1, 2, 42).getMaxIter() == 500
