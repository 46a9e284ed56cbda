"""Holt-Winters with fitted start values and ARIMA(1,1,1) by exact likelihood (FC3, FC5, FC6)."""

import datetime as dt
import itertools

import numpy as np
import pytest

from ledgerline.operators import forecast as FC
from ledgerline.operators import series_models as M


def some_series(n=60):
    rng = np.random.default_rng(8)
    t = np.arange(n)
    return np.stack([
        50 + 2.0 * t + 10 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 1, n), np.cumsum(rng.normal(0, 5, n)) + 200,
        rng.normal(1000, 30, n), 1e6 * np.exp(0.02 * t) + 1e5 * np.cos(2 * np.pi * t / 12),
        np.where(t % 12 == 11, 500.0, 20.0) + rng.normal(0, 2, n), np.maximum(0, 100 - 3.0 * t) + rng.random(n)])


@pytest.mark.parametrize("n, m", [(60, 12), (20, 0), (30, 7)])
def test_holt_winters_is_no_worse_than_any_grid_point(n, m):
    y = some_series(n)
    y = y / np.abs(y).max(axis=1, keepdims=True)
    res, forecast, half = M.holt_winters(y, 6, m or 12)
    grid = np.array(list(itertools.product(np.arange(0.05, 1.0, 0.1), [0.0, 0.01, 0.05, 0.1, 0.2, 0.3],
                                           [0.0, 0.05, 0.1, 0.2, 0.4] if m else [0.0])))
    for i in range(len(y)):
        best = M.holt_winters_sse(np.repeat(y[i:i + 1], len(grid), axis=0), grid, m).min()
        assert (res[i] ** 2).sum() <= best * (1 + 1e-6) + 1e-12
    assert np.isfinite(forecast).all() and (half >= 0).all()


def test_holt_winters_errors_are_those_of_the_plain_recursion():
    y, m = some_series()[:1], 12
    shares = np.array([[0.3, 0.2, 0.4]])
    starts, sse = M._best_starts(M._products(y, shares, m))
    (a, b, g), (level, trend, *season) = shares[0], starts[0]
    total = 0.0
    for t, value in enumerate(y[0]):
        s = season[t]
        error = value - (level + trend + s)
        new = a * (value - s) + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend
        season.append(g * (value - new) + (1 - g) * s)
        level, total = new, total + error ** 2
    assert total == pytest.approx(sse[0], rel=1e-6)


def dense_deviance(x, phi, theta):
    """From the full covariance matrix of an ARMA(1,1) with unit noise."""
    n = len(x)
    acf = np.empty(n)
    acf[0] = (1 + 2 * phi * theta + theta ** 2) / (1 - phi ** 2)
    acf[1:] = (phi * acf[0] + theta) * phi ** np.arange(n - 1)
    cov = acf[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    return np.log(x @ np.linalg.solve(cov, x) / n) + np.linalg.slogdet(cov)[1] / n


def test_arma_likelihood_equals_the_dense_one():
    x = np.diff(some_series(), axis=1)
    for phi, theta in [(0.5, 0.3), (-0.7, 0.2), (0.9, -0.95), (0.0, 0.0)]:
        got = M.arma_deviance(x, np.full(len(x), phi), np.full(len(x), theta))
        assert np.allclose(got, [dense_deviance(r, phi, theta) for r in x], rtol=1e-8)


def test_arima_finds_the_likelihoods_top_and_its_variances():
    rng = np.random.default_rng(1)
    e = rng.normal(0, 2, 400)
    x = np.zeros(400)
    for t in range(1, 400):
        x[t] = 0.6 * x[t - 1] + e[t] + 0.3 * e[t - 1]
    y = 100 + np.cumsum(x)
    res, forecast, half = M.arima111(y[None], 5)
    d = np.diff(y)
    found = M.compass_search(lambda w, p: M.arma_deviance(d[None][w], p[:, 0], p[:, 1]), 1, M._ARMA_STARTS, -0.9999,
                             0.9999, 0.25)[0]
    top = dense_deviance(d, *found)
    assert all(dense_deviance(d, p, q) > top for p in np.arange(-0.9, 1, 0.3) for q in np.arange(-0.9, 1, 0.3))
    fine = [dense_deviance(d, p, q) for p in found[0] + np.array([-0.01, 0, 0.01]) for q in found[1] + np.array([-0.01, 0, 0.01])]
    assert min(fine) == pytest.approx(fine[4], abs=1e-7)
    # Conditional mean and variance of the next levels from the joint covariance.
    phi, theta = found
    n, h = len(d), 5
    acf = np.empty(n + h)
    acf[0] = (1 + 2 * phi * theta + theta ** 2) / (1 - phi ** 2)
    acf[1:] = (phi * acf[0] + theta) * phi ** np.arange(n + h - 1)
    cov = acf[np.abs(np.subtract.outer(np.arange(n + h), np.arange(n + h)))]
    gain = cov[n:, :n] @ np.linalg.inv(cov[:n, :n])
    sigma2 = d @ np.linalg.solve(cov[:n, :n], d) / n
    add = np.tril(np.ones((h, h)))
    assert np.allclose(forecast[0], y[-1] + add @ gain @ d, rtol=1e-6)
    want = 1.96 * np.sqrt(sigma2 * np.diag(add @ (cov[n:, n:] - gain @ cov[:n, n:]) @ add.T))
    assert np.allclose(half[0], want, rtol=1e-4)


def test_series_side_by_side_equal_series_alone():
    y = some_series()
    for fit in (M.holt_winters, M.fourier_ridge, M.arima111):
        together = fit(y, 4, 12)
        for i in range(len(y)):
            for one, many in zip(fit(y[i:i + 1], 4, 12), together):
                assert np.allclose(one[0], many[i], rtol=1e-6, atol=1e-6 * np.abs(y[i]).max())


def test_forecast_of_many_series_with_gaps_and_constants(spark):
    start = dt.datetime(2020, 1, 1)
    rows = [(f"s{i}", start + dt.timedelta(days=31 * j), float(100 + 5 * j + i)) for i in range(40) for j in range(20 + i % 3)]
    rows += [("flat", start + dt.timedelta(days=31 * j), 7.0) for j in range(30)]
    rows += [("zero", start + dt.timedelta(days=31 * j), 0.0) for j in range(30)]
    rows += [("short", start, 1.0), ("short", start + dt.timedelta(days=1), 2.0), (None, start, None)]
    out = FC.forecast(spark.createDataFrame(rows, "k string, d timestamp_ntz, v double"), "d", "v", 3, "M", "k").toPandas()
    assert len(out) == 42 * 3 + 1
    assert out.loc[out["series"] == "short", "model"].tolist() == ["too_few_points"]
    assert np.allclose(out.loc[out["series"] == "flat", "forecast"], 7.0)
    assert np.allclose(out.loc[out["series"] == "zero", "forecast"], 0.0)
    assert FC.forecast(spark.createDataFrame([], "d timestamp_ntz, v double"), "d", "v").count() == 0
