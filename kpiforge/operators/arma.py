"""ARIMA(p, d, q) by two-stage innovations regression (M7).

A long autoregression estimates the innovations; least squares on lags of
the series and of the innovations then gives every order's coefficients,
and its own innovations (by recursion) the AIC. All orders of one ``d``
are judged on the same rows. Series are short (a key's history): each is
one group of ``applyInPandas``, keys are spread over the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

ORDERS = [(p, d, q) for d in (0, 1) for p in (0, 1, 2) for q in (0, 1, 2)]
LAGS = 2
UNIT = 0.99      # largest root of an autoregression that counts as stationary


def _lags(z: np.ndarray, n: int, start: int) -> list[np.ndarray]:
    return [z[start - j:len(z) - j] for j in range(1, n + 1)]


def innovations(z: np.ndarray, m: int) -> np.ndarray:
    """Residuals of the autoregression of order m; the first m are 0."""
    x = np.column_stack([np.ones(len(z) - m), *_lags(z, m, m)])
    coef, *_ = np.linalg.lstsq(x, z[m:], rcond=None)
    return np.concatenate([np.zeros(m), z[m:] - x @ coef])


def fit_order(z: np.ndarray, p: int, q: int, e: np.ndarray, start: int):
    """(const, AR coefficients, MA coefficients, innovations, AIC), or None
    where the moving average cannot be inverted or the autoregression is
    (nearly) without a fixed level, which differencing is for."""
    x = np.column_stack([np.ones(len(z) - start), *_lags(z, p, start), *_lags(e, q, start)])
    coef, *_ = np.linalg.lstsq(x, z[start:], rcond=None)
    c, ar, ma = coef[0], coef[1:p + 1], coef[p + 1:]
    if np.any(np.abs(np.roots([1.0, *ma])) >= 1) or np.any(np.abs(np.roots([1.0, *-ar])) >= UNIT):
        return None
    own = np.zeros(len(z))
    for t in range(max(p, q), len(z)):
        own[t] = z[t] - c - ar @ z[t - p:t][::-1] - ma @ own[t - q:t][::-1]
    n = len(z) - start
    sse = float(own[start:] @ own[start:])
    aic = n * np.log(sse / n) + 2 * (p + q + 1) if sse > 0 else -np.inf
    return c, ar, ma, own, aic


def best_order(y: np.ndarray):
    """(p, d, q, fit, differenced series) of least AIC (ties: the order
    listed first); None for series that are too short for any order."""
    best = None
    for d in (0, 1):
        z = np.diff(y) if d else y
        m = min(int(round(np.log(max(len(z), 2)) ** 1.5)), (len(z) - 4) // 4)
        if m < 1:
            continue
        e, start = innovations(z, m), m + LAGS
        for p, dd, q in ORDERS:
            if dd != d or len(z) - start <= p + q + 2:
                continue
            r = fit_order(z, p, q, e, start)
            if r is not None and np.isfinite(r[1]).all() and (best is None or r[4] < best[3][4]):
                best = (p, d, q, r, z)
    return best


def forecast(y: np.ndarray, horizon: int):
    """(p, d, q, AIC, forecasts); future innovations are 0."""
    best = best_order(y)
    if best is None:
        return None
    p, d, q, (c, ar, ma, own, aic), z = best
    hist, inn, level, out = list(z), list(own), y[-1], []
    for _ in range(horizon):
        nxt = c + sum(ar[j] * hist[-j - 1] for j in range(p)) + sum(ma[j] * inn[-j - 1] for j in range(q))
        hist.append(nxt)
        inn.append(0.0)
        level = level + nxt if d else nxt
        out.append(float(level))
    return p, d, q, float(aic), out


SCHEMA = "p int, d int, q int, aic double, step int, forecast double"


def forecast_group(key: str, horizon: int):
    """The per-series function for ``applyInPandas``: rows of (t, x), null x
    left out; a series that is too short for any order gives no row."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.dropna(subset=["x"]).sort_values(["t", "x"])["x"].to_numpy(dtype=float)
        got = forecast(y, horizon)
        p, d, q, aic, out = got or (0, 0, 0, 0.0, [])
        n = len(out)
        return pd.DataFrame({key: pd.Series([pdf[key].iloc[0]] * n, dtype=object), "p": [p] * n, "d": [d] * n, "q": [q] * n, "aic": [aic] * n, "step": range(1, n + 1), "forecast": out})
    return run
