"""The reference's own test inputs, rebuilt inline, with its assertions."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest


from ledgerline.operators import automl, clean, drift, features, personas, profile, questions


def test_hr_small_clean(spark):
    pdf = pd.DataFrame({"Age": [25.0, np.nan, 35.0, 25.0, 45.0],
                        "Salary": [50000.0, 60000.0, np.nan, 50000.0, 80000.0],
                        "Department": ["HR", "IT", "IT", "HR", "Finance"]})
    df = spark.createDataFrame(pdf)
    before = profile.quality(df, with_outliers=False).first()["score"]
    assert clean.dedup_count(df).first()["removed"] == 1
    deduped = clean.dedup(df)
    assert deduped.count() == 4
    filled = clean.impute(deduped)
    assert sum(clean.missing_counts(filled).values()) == 0
    after = profile.quality(filled, with_outliers=False).first()["score"]
    assert after >= before


def test_encode_small_scaling(spark):
    pdf = pd.DataFrame({"Feature1": [10.0, 20.0, 30.0, 40.0, 50.0],
                        "Category1": ["A", "B", "A", "C", "B"], "Target": [0, 1, 0, 1, 0]})
    df = spark.createDataFrame(pdf)
    enc, _ = features.label_encode(df, ["Category1"])
    assert [r[0] for r in enc.select("Category1").collect()] == [0.0, 1.0, 0.0, 2.0, 1.0]
    scaled = features.standard_scale(df, ["Feature1"]).toPandas()["Feature1"]
    assert abs(scaled.mean()) < 1e-12
    assert abs(scaled.std(ddof=1) - 1.11803) < 1e-4


def test_sales_dup_quality(spark):
    pdf = pd.DataFrame({"Date": ["2023-01-01", "2023-01-02", "2023-01-02", "2023-01-03", "2023-01-04"],
                        "Sales": [100.0, 200.0, 200.0, np.nan, 300.0],
                        "Category": ["A", "B", "B", "A", "C"]})
    df = spark.createDataFrame(pdf)
    assert clean.dedup_count(df).first()["removed"] == 1
    assert clean.impute_counts(clean.dedup(df)).collect()[0]["column"] == "Sales"
    assert profile.quality(df, with_outliers=False).first()["score"] > 70


def test_target_probe_problem_types(spark):
    pdf = pd.DataFrame({"Age": [22, 25, 47, 52, 46, 56, 55, 60, 62, 61],
                        "Salary": [20000.0, 25000.0, 60000.0, 65000.0, 52000.0, 70000.0, 68000.0, 72000.0,
                                   80000.0, 75000.0],
                        "Purchased": [0, 0, 1, 1, 1, 1, 1, 1, 1, 1]})
    df = spark.createDataFrame(pdf)
    prof = {r["column"]: r for r in profile.profile(df).collect()}
    assert prof["Salary"]["distinct_count"] > 5
    assert prof["Purchased"]["distinct_count"] == 2
    assert automl.problem_type(df, "Purchased") == "classification"


def test_nl_sales_region_question(spark):
    pdf = pd.DataFrame({"Date": ["2023-01-01", "2023-02-01", "2023-03-01", "2023-04-01"],
                        "Sales": [100, 400, 150, 200], "Region": ["North", "South", "East", "West"],
                        "Product": ["A", "B", "A", "C"]})
    out = questions.ask(spark.createDataFrame(pdf), "Which region has maximum sales?")
    top = out.where("rank = 1").first()
    assert top["segment"] == "South"


def test_personas_three_segments(spark):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({"CustomerID": range(1, 13), "Sales": rng.uniform(100, 1000, 12).round(2),
                        "Transactions": rng.integers(1, 20, 12)})
    out = personas.personas(spark.createDataFrame(pdf), k=3).collect()
    assert len(out) == 3
    assert {r["kpi"] for r in out} == {"Sales"}
    assert out[0]["persona"] == "High-Value Champions"
    assert sum(r["count"] for r in out) == 12


def test_perturbation_has_drivers(spark):
    rng = np.random.default_rng(0)
    x1, x2 = rng.normal(0, 2, 200), rng.normal(0, 1, 200)
    pdf = pd.DataFrame({"Feature1": x1, "Feature2": x2, "Target": 2 * x1 - x2, "rid": range(200)})
    df = spark.createDataFrame(pdf)
    res = automl.train(df.drop("rid"), "Target", problem="regression", models=["Linear Regression"], cv_folds=2,
                       tune=False)
    ex = automl.explain(res, df, "rid").where("rid = 0").collect()
    assert len(ex) == 2
    assert abs(sum(abs(r["impact"]) for r in ex) - 100) < 0.1


def test_kpi_drop_root_cause(spark):
    start = dt.datetime(2026, 1, 1)
    rng = np.random.default_rng(7)
    rows = []
    for d in range(60):
        sales = 1000.0 if d < 30 else 500.0
        rows.append((start + dt.timedelta(days=d), sales, str(rng.choice(["North", "South", "East"]))))
    df = spark.createDataFrame(rows, "Date timestamp_ntz, Sales double, Region string")
    found = questions.root_cause(df, "Sales", "Date").collect()
    assert len(found) >= 1
    assert found[0]["overall_change"] < 0


def test_drift_feature1_only(spark):
    rng = np.random.default_rng(42)
    train = pd.DataFrame({"Feature1": rng.normal(10, 2, 100), "Feature2": rng.normal(5, 1, 100)})
    infer = pd.DataFrame({"Feature1": rng.normal(15, 2, 100), "Feature2": rng.normal(5, 1, 100)})
    out = {r["feature"]: r for r in drift.drift(spark.createDataFrame(train), spark.createDataFrame(infer),
                                                ["Feature1", "Feature2"]).collect()}
    assert out["Feature1"]["drift_detected"]
    assert not out["Feature2"]["drift_detected"]


def test_alert_low_quality(spark):
    from ledgerline.operators import alerts
    q = spark.createDataFrame([("p", "d", "sales.csv", 45.0)], "project_id string, dataset_id string, "
                                                              "filename string, score double")
    out = alerts.scan_alerts(quality=q).collect()
    assert out[0]["severity"] == "CRITICAL" and out[0]["is_read"] is False


def test_one_model_leaderboard(spark):
    pdf = pd.DataFrame({"Feature1": range(1, 51), "Target": [10 * i for i in range(1, 51)]})
    res = automl.train(spark.createDataFrame(pdf), "Target", models=["Random Forest"], cv_folds=2, tune=False)
    names = [r["model_name"] for r in res.leaderboard.collect()]
    assert names == ["Random Forest"]


@pytest.mark.parametrize("sel,expect", [(["linear regression"], "Logistic Regression"),
                                        (["nothing"], None)])
def test_model_subset_alias(sel, expect):
    chosen = automl.select_models("classification", sel)
    if expect:
        assert expect in chosen
    else:
        assert chosen == automl.CLASSIFIERS


def test_feature_suggestions_rules(spark):
    pdf = pd.DataFrame({"order_date": pd.date_range("2024-01-01", periods=200).astype(str),
                        "kind": ["a", "b", "c", "d"] * 50,
                        "amount": np.r_[np.ones(190), np.arange(10) * 1000.0] + np.arange(200) * 0.001})
    out = {(r["column"], r["type"]) for r in clean.suggest_features(spark.createDataFrame(pdf)).collect()}
    assert ("order_date", "datetime_extraction") in out
    assert ("kind", "one_hot_encoding") in out
    assert ("amount", "log_transformation") in out
