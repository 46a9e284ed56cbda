"""Distributed algorithms checked against brute-force NumPy / pandas versions."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.functions.quantiles import exact_quantiles, kth_smallest
from ledgerline.operators import anomaly, drift, series_models, summary
from ledgerline.operators import forecast as FC
from ledgerline.streaming import rate_limit


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=300), st.floats(0, 1))
def test_exact_quantile_matches_numpy(spark, values, q):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = exact_quantiles(df, "x", [q])[0]
    assert got == pytest.approx(float(np.quantile(np.array(values, dtype=float), q)), abs=1e-9)


def test_kth_smallest_many_passes(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(0, 1, 30000), np.full(20000, 5.0)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    ranks = [0, 100, 29999, 30000, 49999]
    got = kth_smallest(df, "x", ranks)
    srt = np.sort(vals)
    assert all(got[r] == srt[r] for r in ranks)


@pytest.mark.parametrize("bins", ["auto", 15, 7])
def test_histogram_matches_numpy(spark, bins):
    rng = np.random.default_rng(11)
    vals = np.round(rng.lognormal(3, 1, 5000), 2)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    out = summary.histogram(df, "x", bins).orderBy("bin").collect()
    counts, edges = np.histogram(vals, bins=bins)
    assert [r["count"] for r in out] == counts.tolist()
    # Labels are rounded to cents; Spark rounds half-up on the decimal form.
    assert [r["bin_lo"] for r in out] == pytest.approx(edges[:-1].tolist(), abs=0.0051)


def test_ks_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = np.round(rng.normal(0, 1, 3000), 2), np.round(rng.normal(0.1, 1.2, 2000), 2)
    ta = spark.createDataFrame([(float(v),) for v in a], "f double")
    tb = spark.createDataFrame([(float(v),) for v in b], "f double")
    got = drift.ks_statistics(ta, tb, ["f"], buckets=16).first()
    grid = np.union1d(a, b)
    d = np.max(np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a)
                      - np.searchsorted(np.sort(b), grid, "right") / len(b)))
    assert got["ks_statistic"] == pytest.approx(d, abs=1e-12)
    en = len(a) * len(b) / (len(a) + len(b))
    z = np.sqrt(en) * d
    k = np.arange(1, 101)
    p = 2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k * k * z * z))
    assert got["p_value"] == pytest.approx(min(1.0, max(0.0, p)), abs=1e-9)


def test_isolation_forest_scores_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (500, 2)), [[8.0, 8.0], [-9.0, 7.5]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, a double, b double")
    model = anomaly.fit_isolation_forest(df, ["a", "b"], trees=50, seed=3)
    scored = anomaly.score_isolation_forest(df, model).orderBy("id").toPandas()
    total = np.zeros(len(x))
    for tree in model["arrays"]:
        total += anomaly._path_lengths(x, tree)
    expect = 2.0 ** (-(total / len(model["arrays"])) / anomaly._c(model["psi"]))
    assert np.allclose(scored["iso_score"].to_numpy(), expect)
    assert set(scored.nlargest(2, "iso_score")["id"]) == {500, 501}


def test_reconstruction_error_matches_numpy_pca(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 2))
    x = np.column_stack([base[:, 0], base[:, 1], base[:, 0] + 0.1 * rng.normal(size=400), rng.normal(size=400)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, "
                                                                                "d double")
    out, _ = anomaly.reconstruction_errors(df, ["a", "b", "c", "d"])
    got = out.orderBy("id").toPandas()["recon_error"].to_numpy()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    cov = np.cov(z, rowvar=False)
    w, v = np.linalg.eigh(cov)
    pcs = v[:, np.argsort(w)[::-1][:2]]
    expect = np.mean((z - z @ pcs @ pcs.T) ** 2, axis=1)
    assert np.allclose(got, expect, atol=1e-9)


def test_fourier_dataframe_form_matches_numpy(spark):
    rng = np.random.default_rng(9)
    t = np.arange(40)
    y = 100 + 3 * t + 20 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 2, 40)
    pdf = pd.DataFrame({"series": "s", "period": [dt.date(2020 + (i // 12), i % 12 + 1, 1) for i in t], "t": t,
                        "value": y})
    got = FC.fourier_forecast(spark.createDataFrame(pdf), periods=6).orderBy("step").toPandas()
    res, fc, _ = series_models.fourier_ridge(y[None], 6, 12)
    assert np.allclose(got["forecast"], fc[0], rtol=1e-9)
    assert got["mse"].iloc[0] == pytest.approx((res ** 2).mean(), rel=1e-9)
    assert got["period"].tolist()[:2] == ["2023-05-01", "2023-06-01"]


def test_holt_winters_tracks_trend():
    y = 50 + 2.0 * np.arange(36) + 10 * np.sin(2 * np.pi * np.arange(36) / 12)
    _, fc, half = (v[0] for v in series_models.holt_winters(y[None], 12, 12))
    lo, hi = fc - half, fc + half
    truth = 50 + 2.0 * np.arange(36, 48) + 10 * np.sin(2 * np.pi * np.arange(36, 48) / 12)
    assert np.mean(np.abs(fc - truth)) < 6
    assert (lo <= fc).all() and (fc <= hi).all()


def test_forecast_picks_lowest_mse(spark):
    rows = [(dt.datetime(2020, 1, 1) + dt.timedelta(days=30 * i), float(100 + 5 * i)) for i in range(30)]
    df = spark.createDataFrame(rows, "d timestamp_ntz, v double")
    out = FC.forecast(df, "d", "v", periods=3).toPandas()
    assert len(out) == 3 and out["model"].nunique() == 1
    assert out["forecast"].is_monotonic_increasing


def _brute_rate(times, limit, window_s):
    acc, out = [], []
    for t in times:
        recent = [a for a in acc if t - a < window_s]
        ok = len(recent) < limit
        out.append(ok)
        if ok:
            acc.append(t)
    return out


def test_rate_limit_exact_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for user in range(5):
        t = 0.0
        for _ in range(200):
            t += float(rng.exponential(3.0 if user else 0.5))
            rows.append((len(rows), user, base + dt.timedelta(seconds=t)))
    df = spark.createDataFrame(rows, "rid long, user long, ts timestamp_ntz")
    got = {r["rid"]: r["accepted"] for r in rate_limit.decide(df, "user", "ts", "rid", 10, 5).collect()}
    for user in range(5):
        mine = [(r[0], (r[2] - base).total_seconds()) for r in rows if r[1] == user]
        exp = _brute_rate([t for _, t in mine], 5, 10)
        assert [got[i] for i, _ in mine] == exp
    off = rate_limit.offered_load(df, "user", "ts", 10, 5).where("breach").count()
    assert off >= sum(1 for v in got.values() if not v)


def test_order_statistics_narrowing_passes(spark, monkeypatch):
    """Force the histogram-narrowing path (used when brackets hold many values)."""
    import ledgerline.functions.quantiles as Qm
    monkeypatch.setattr(Qm, "_FETCH_LIMIT", 50)
    monkeypatch.setattr(Qm, "_ACCURACY", 20)
    rng = np.random.default_rng(8)
    a = np.concatenate([rng.exponential(3, 20000), np.full(5000, 1.0)])
    b = rng.integers(0, 40, 25000).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    got = Qm.column_quantiles(df, ["a", "b"], [0.01, 0.25, 0.5, 0.99])
    assert got["a"] == pytest.approx(np.quantile(a, [0.01, 0.25, 0.5, 0.99]).tolist(), abs=1e-12)
    assert got["b"] == pytest.approx(np.quantile(b, [0.01, 0.25, 0.5, 0.99]).tolist(), abs=1e-12)


def test_grouped_quantiles_match_pandas(spark):
    from ledgerline.functions.quantiles import grouped_quantiles
    rng = np.random.default_rng(12)
    g = np.where(rng.random(20000) < 0.6, "hot", rng.choice(["a", "b", "c"], 20000))
    v = np.round(rng.gamma(2.0, 3.0, 20000), 3)
    pdf = pd.DataFrame({"g": g, "v": v})
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = grouped_quantiles(spark.createDataFrame(pdf), "g", "v", probs, buckets=8).toPandas()
    exp = pdf.groupby("g")["v"].quantile(probs)
    for r in got.itertuples():
        assert r.value == pytest.approx(exp[(r.g, r.q)], abs=1e-9)
    assert len(got) == 4 * len(probs)


def test_rate_limit_pieces_cross_buckets(spark):
    """Small buckets force pieces to span bucket borders."""
    rng = np.random.default_rng(21)
    base = dt.datetime(2024, 1, 1)
    rows, t = [], 0.0
    for i in range(1500):
        t += float(rng.choice([0.3, 1.0, 25.0], p=[0.6, 0.35, 0.05]))
        rows.append((i, 7, base + dt.timedelta(seconds=t)))
    df = spark.createDataFrame(rows, "rid long, user long, ts timestamp_ntz")
    got = {r["rid"]: r["accepted"] for r in rate_limit.decide(df, "user", "ts", "rid", 10, 4, span_windows=2).collect()}
    exp = _brute_rate([(r[2] - base).total_seconds() for r in rows], 4, 10)
    assert [got[r[0]] for r in rows] == exp


def test_cross_validation_is_one_fit_a_fold(spark, monkeypatch):
    """The scores are those of Spark's cross-validator, which would fit all rows once more; a fold without rows is an error."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator

    from ledgerline.operators import automl
    rows = spark.range(0, 300, 1, 3).selectExpr("cast(id % 17 as double) as x", "cast(id % 5 as int) as fold", """
        3 * (id % 17) + 0.01D * (id * id % 97) as label""")
    plain = automl.train(rows.select("x", "label"), "label", problem="regression", models=["Linear Regression"])
    fits, fit = [], LinearRegression._fit
    monkeypatch.setattr(LinearRegression, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    again = automl.train(rows.select("x", "label"), "label", problem="regression", models=["Linear Regression"])
    assert len(fits) == 6                       # the holdout's and five folds'
    assert again.leaderboard.first()["cv_score"] == plain.leaderboard.first()["cv_score"]

    from pyspark.ml.feature import VectorAssembler
    ready = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows).withColumnRenamed("fold", "_fold")
    judge = RegressionEvaluator(metricName="r2")
    spark_cv = CrossValidator(estimator=LinearRegression(), estimatorParamMaps=[{}], evaluator=judge, foldCol="_fold", numFolds=5)
    want = spark_cv.fit(ready).avgMetrics[0]
    assert abs(automl._cross_validated(LinearRegression(), ready, judge, 5) - want) < 1e-9
    for left, what in (("_fold <> 3", "validation data at fold 3"), ("_fold = 0", "training data at fold 0")):
        with pytest.raises(ValueError, match=what):
            automl._cross_validated(LinearRegression(), ready.where(left), judge, 5)
