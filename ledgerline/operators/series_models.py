"""Forecast models fitted side by side for a batch of equally long series (FC3, FC4, FC5).

Every function takes an array of series (one per row) and returns per series
the residuals, the forecast and the half width of its 95 % band. Parameters are
found by a compass search from several starts, all series and starts at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_HW_STARTS = np.array([[0.1, 0.05, 0.05], [0.5, 0.05, 0.1], [0.9, 0.05, 0.05], [0.3, 0.5, 0.3], [0.02, 0.02, 0.5],
                       [0.7, 0.3, 0.8]])
_ARMA_STARTS = np.array([[0.1, 0.1], [0.7, -0.4], [-0.5, 0.5], [0.9, -0.8], [-0.3, -0.6], [0.4, 0.6]])


def compass_search(loss: Callable[[np.ndarray, np.ndarray], np.ndarray], series: int, starts: np.ndarray,
                   low: float, high: float, step: float, least: float = 1e-4) -> np.ndarray:
    """Per series the best point found: from each start the best step, doubled after a gain and halved when none helps.

    Steps go along the axes, in the plane also along the diagonals. ``loss(which, points)`` gives the losses of
    ``points`` for the series numbered ``which``.
    """
    dims = starts.shape[1]
    which = np.repeat(np.arange(series), len(starts))
    at = np.tile(starts, (series, 1)).astype(float)
    value = loss(which, at)
    size = np.full(len(at), step)
    moves = np.concatenate([np.eye(dims), -np.eye(dims)])
    if dims == 2:
        moves = np.concatenate([moves, [[1, 1], [1, -1], [-1, 1], [-1, -1]]])
    for _ in range(400):
        live = np.flatnonzero(size >= least)
        if not len(live):
            break
        tries = np.clip(at[live, None, :] + size[live, None, None] * moves, low, high)
        losses = loss(np.repeat(which[live], len(moves)), tries.reshape(-1, dims)).reshape(len(live), len(moves))
        best = losses.argmin(axis=1)
        found = losses[np.arange(len(live)), best]
        better = found < value[live]
        at[live[better]] = tries[better, best[better]]
        value[live[better]] = found[better]
        size[live] *= np.where(better, 2.0, 0.5)
    return at.reshape(series, len(starts), dims)[np.arange(series), value.reshape(series, -1).argmin(axis=1)]


# ---------------------------------------------------------------- Holt–Winters
def _smooth(y: np.ndarray, shares: np.ndarray, m: int, level, trend, season):
    """One-step errors, point by point, and at last the state: columns of ``y`` run through the same recursion."""
    a, b, g = (shares[:, i, None] for i in range(3))
    for t in range(y.shape[1]):
        s = season[..., t % m] if m else 0.0
        error = y[:, t] - (level + trend + s)
        yield error
        new = level + trend + a * error
        trend = b * (new - level) + (1 - b) * trend
        level = new
        if m:
            season[..., t % m] = s + g * (1 - a) * error
    yield level, trend, season


def _start_columns(series: int, m: int):
    """Level, trend and season of a run without start values (column 0) and of one run per unit start value."""
    p = 2 + m
    level, trend, season = np.zeros((series, 1 + p)), np.zeros((series, 1 + p)), np.zeros((series, 1 + p, max(m, 1)))
    level[:, 1], trend[:, 2] = 1.0, 1.0
    for j in range(m):
        season[:, 3 + j, j] = 1.0
    return level, trend, season


def _products(y: np.ndarray, shares: np.ndarray, m: int) -> np.ndarray:
    """Cross products of the error columns; errors are linear in the start values, so these give the best ones."""
    columns = 3 + m
    total = np.zeros((len(y), columns, columns))
    wide = np.zeros((len(y), y.shape[1], columns))
    wide[:, :, 0] = y
    for error in _smooth(wide, shares, m, *_start_columns(len(y), m)):
        if isinstance(error, tuple):
            return total
        total += error[:, :, None] * error[:, None, :]


def _best_starts(products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start values, sum of squares) per series; level and season trade off freely, the shortest solution is taken."""
    inverse = np.linalg.pinv(products[:, 1:, 1:], rcond=1e-11, hermitian=True)
    starts = -np.einsum("nij,nj->ni", inverse, products[:, 1:, 0])
    sse = products[:, 0, 0] + np.einsum("ni,ni->n", starts, products[:, 1:, 0])
    return starts, np.maximum(sse, 0.0)


def holt_winters_sse(y: np.ndarray, shares: np.ndarray, m: int) -> np.ndarray:
    """Least sum of squared errors of each series for given smoothing shares, over all start values."""
    return _best_starts(_products(y, shares, m))[1]


def holt_winters(y: np.ndarray, periods: int, season: int):
    """FC3: additive trend, additive season if there are more than two; smoothing and start values least-squares fitted.

    The season's smoothing share is that of what the level leaves over, the trend's that of the level's change.
    """
    y = np.asarray(y, dtype=float)
    n = y.shape[1]
    m = season if n > 2 * season else 0
    scale = np.maximum(np.abs(y).max(axis=1), 1e-300)[:, None]
    z = y / scale
    starts = _HW_STARTS if m else _HW_STARTS * [1, 1, 0]
    shares = compass_search(lambda which, points: holt_winters_sse(z[which], points * [1, 1, bool(m)], m), len(z),
                            starts, 0.0, 1.0, 0.25)
    shares = shares * [1, 1, bool(m)]
    first, _ = _best_starts(_products(z, shares, m))
    season_now = first[:, None, 2:].copy() if m else np.zeros((len(z), 1, 1))
    *errors, (level, trend, season_now) = _smooth(z[:, :, None], shares, m, first[:, :1], first[:, 1:2], season_now)
    res = np.stack([e[:, 0] for e in errors], axis=1) * scale
    ahead = np.arange(1, periods + 1)
    forecast = (level + ahead * trend + (season_now[:, 0, (n + ahead - 1) % m] if m else 0.0)) * scale
    return res, forecast, np.repeat(1.96 * res.std(axis=1, ddof=1)[:, None], periods, axis=1)


# ---------------------------------------------------------------- Fourier ridge
def fourier_ridge(y: np.ndarray, periods: int, season: int, alpha: float = 1.0):
    """FC4: trend and one harmonic of the season, ridge with intercept."""
    y = np.asarray(y, dtype=float)

    def design(t):
        return np.column_stack([t, np.sin(2 * np.pi * t / season), np.cos(2 * np.pi * t / season)])

    x = design(np.arange(y.shape[1], dtype=float))
    centred, mean = x - x.mean(axis=0), y.mean(axis=1, keepdims=True)
    weights = np.linalg.solve(centred.T @ centred + alpha * np.eye(3), centred.T @ (y - mean).T).T
    base = mean - (weights @ x.mean(axis=0))[:, None]
    res = y - (weights @ x.T + base)
    forecast = weights @ design(np.arange(y.shape[1], y.shape[1] + periods, dtype=float)).T + base
    return res, forecast, np.repeat(1.96 * res.std(axis=1)[:, None], periods, axis=1)


# ---------------------------------------------------------------- ARIMA(1,1,1)
def _innovations(x: np.ndarray, phi: np.ndarray, theta: np.ndarray):
    """Errors of the exact one-step predictions of an ARMA(1,1) and their variances over that of the noise."""
    r = (1 + 2 * phi * theta + theta ** 2) / (1 - phi ** 2)
    guess = np.zeros(len(x))
    errors, ratios = np.empty_like(x), np.empty((len(x), x.shape[1] + 1))
    for t in range(x.shape[1]):
        errors[:, t], ratios[:, t] = x[:, t] - guess, r
        guess = phi * x[:, t] + theta / r * errors[:, t]
        r = 1 + theta ** 2 - theta ** 2 / r
    ratios[:, -1] = r
    return errors, ratios, guess


def arma_deviance(x: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """-2 log likelihood per point of an ARMA(1,1) with the best noise variance, less the constant log(2 pi) + 1."""
    errors, ratios, _ = _innovations(x, phi, theta)
    ratios = ratios[:, :-1]
    return np.log(np.maximum((errors ** 2 / ratios).mean(axis=1), 1e-300)) + np.log(ratios).mean(axis=1)


def arima111(y: np.ndarray, periods: int, season: int = 0):
    """FC5: ARIMA(1,1,1) by exact Gaussian likelihood of the differences, with its own prediction variances."""
    y = np.asarray(y, dtype=float)
    x = np.diff(y, axis=1)
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300)[:, None]
    z = x / scale
    found = compass_search(lambda which, p: arma_deviance(z[which], p[:, 0], p[:, 1]), len(z), _ARMA_STARTS,
                           -0.9999, 0.9999, 0.25)
    phi, theta = found[:, 0], found[:, 1]
    errors, ratios, step = _innovations(z, phi, theta)
    sigma2 = (errors ** 2 / ratios[:, :-1]).mean(axis=1)
    res = np.concatenate([y[:, :1], errors * scale], axis=1)  # the first value has no prediction but 0
    power = phi[:, None] ** np.arange(periods)
    forecast = y[:, -1:] + np.cumsum(step[:, None] * power, axis=1) * scale
    # Error j ahead moves each later difference by phi^(i-1) (phi + theta / r_j), and the level by their sum.
    r, var = ratios[:, -1], np.zeros((len(y), periods))
    reach = np.cumsum(power, axis=1)
    for j in range(periods):
        weight = np.ones((len(y), periods - j))
        weight[:, 1:] += (phi + theta / r)[:, None] * reach[:, :periods - j - 1]
        var[:, j:] += r[:, None] * weight ** 2
        r = 1 + theta ** 2 - theta ** 2 / r
    return res, forecast, 1.96 * np.sqrt(sigma2[:, None] * var) * scale
