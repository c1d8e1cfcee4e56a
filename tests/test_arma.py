"""ARIMA orders on processes whose coefficients are known."""

from __future__ import annotations

import numpy as np
import pytest

from kpiforge.operators import arma


def process(ar, ma, n=6000, c=0.0, seed=4):
    e = np.random.default_rng(seed).normal(size=n + 200)
    z = np.zeros(n + 200)
    for t in range(2, n + 200):
        z[t] = c + e[t] + sum(a * z[t - j - 1] for j, a in enumerate(ar)) + sum(m * e[t - j - 1] for j, m in enumerate(ma))
    return z[200:]


CASES = [((), ()), ((0.6,), ()), ((0.5, -0.3), ()), ((), (0.7,)), ((), (0.5, 0.3)), ((0.5,), (0.4,)), ((0.5, -0.3), (0.5,)), ((0.6,), (0.5, 0.3)), ((0.5, -0.4), (0.6, 0.3))]


@pytest.mark.parametrize("ar,ma", CASES)
def test_coefficients_of_every_order(ar, ma):
    z = process(ar, ma, c=1.0)
    m = 25
    c, a, b, own, _ = arma.fit_order(z, len(ar), len(ma), arma.innovations(z, m), m + arma.LAGS)
    assert np.allclose(a, ar, atol=0.08) and np.allclose(b, ma, atol=0.08) and abs(c - 1) < 0.15
    assert abs(own[100:].std() - 1) < 0.05


@pytest.mark.parametrize("ar,ma", [((0.7,), ()), ((), (0.8,)), ((0.6,), (0.5,))])
def test_least_aic_finds_the_order(ar, ma):
    """The chosen order is the same process, whatever terms it has beyond."""
    p, d, q, (_, a, b, _, _), _ = arma.best_order(process(ar, ma))
    assert d == 0 and p + q <= len(ar) + len(ma) + 2
    assert np.allclose(weights(a, b), weights(ar, ma), atol=0.12)


def weights(ar, ma, n=6):
    """Weights of the process as an infinite moving average."""
    w = [1.0]
    for i in range(1, n):
        w.append((ma[i - 1] if i <= len(ma) else 0.0) + sum(ar[j] * w[i - j - 1] for j in range(min(i, len(ar)))))
    return np.array(w)


def test_difference_and_forecast():
    y = np.cumsum(process((), (0.7,), c=0.5))
    p, d, q, aic, out = arma.forecast(y, 12)
    assert d == 1 and len(out) == 12
    assert abs((out[-1] - out[1]) / 10 - 0.5) < 0.1           # drift beyond the moving average's reach


def test_short_constant_and_null(spark):
    rows = [("short", t, float(t)) for t in range(4)] + [("flat", t, 5.0) for t in range(40)] + [("holes", t, None if t % 7 == 0 else float(t % 5)) for t in range(80)]
    df = spark.createDataFrame(rows, "region string, t int, x double")
    got = df.groupBy("region").applyInPandas(arma.forecast_group("region", 3), "region string, " + arma.SCHEMA).collect()
    assert {r.region for r in got} == {"flat", "holes"} and len(got) == 6
    assert all(abs(r.forecast - 5) < 1e-6 for r in got if r.region == "flat") and all(np.isfinite(r.forecast) for r in got)
