"""Series forecasting and evaluation as relational operators (M1–M9).

Many series at once, each row of the input is (key, position, value).
The walk-forward back-test never re-scans a train window: the expanding
mean growth is a running window aggregate, each fold emits ``horizon``
rows (``explode(sequence)``), and the actuals are joined back on
(key, position). Windows are partitioned by series (or by series × fold),
so a task holds one series' points, not the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_div


def positions(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, t, x): 1-based position per series, NULL values dropped first."""
    w = Window.partitionBy(key).orderBy(*order)
    return (df.filter(F.col(value).isNotNull())
            .select(key, *order, F.col(value).cast("double").alias("x"))
            .withColumn("t", F.row_number().over(w)).select(key, "t", "x"))


def walk_forward(pts: DataFrame, key: str, horizon: int, min_train: int, step: int = 1) -> DataFrame:
    """Fold forecasts: one row per (key, train_end k, step i) with the
    prediction x_k·(1 + mean growth over the first k points)^i and the
    actual x_{k+i}. Folds: k = min_train, min_train+step, …, k + h ≤ n."""
    w = Window.partitionBy(key).orderBy("t")
    g = pts.withColumn("g", safe_div(F.col("x") - F.lag("x").over(w), F.lag("x").over(w)))
    # One sorted window gives the growth so far and the next ``horizon`` actuals.
    g = (g.withColumn("G", F.avg("g").over(w.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("next", F.collect_list("x").over(w.rowsBetween(1, horizon))))
    folds = g.filter((F.col("t") >= min_train) & (F.size("next") == horizon)
                     & (((F.col("t") - min_train) % step) == 0))
    steps = folds.select(key, F.col("t").alias("train_end"), F.col("x").alias("last"), "G",
                         F.posexplode("next").alias("i", "actual")).withColumn("i", F.col("i") + 1)
    growth = F.when(F.col("train_end") >= 2, F.coalesce("G", F.lit(0.0))).otherwise(F.lit(0.0))
    return steps.withColumn("pred", F.col("last") * F.pow(F.lit(1.0) + growth, F.col("i").cast("double")))


def fold_metrics(fc: DataFrame, key: str, horizon: int) -> DataFrame:
    """MAPE (zero actuals skipped, 0 if none), RMSE, MAE, directional
    accuracy (50 when horizon < 2) and mean error (actual − prediction)."""
    w = Window.partitionBy(key, "train_end").orderBy("i")
    fc = (fc.withColumn("_da", F.signum(F.col("actual") - F.lag("actual").over(w)))
          .withColumn("_dp", F.signum(F.col("pred") - F.lag("pred").over(w))))
    err = F.col("actual") - F.col("pred")
    ape = F.when(F.col("actual") != 0, F.abs(err / F.col("actual")))
    direction = (F.lit(50.0) if horizon < 2 else
                 F.avg(F.when(F.col("_da").isNotNull(), F.when(F.col("_da") == F.col("_dp"), 100.0).otherwise(0.0))))
    return fc.groupBy(key, "train_end").agg(
        F.coalesce(F.avg(ape) * 100.0, F.lit(0.0)).alias("mape"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        direction.alias("directional_accuracy"),
        F.avg(err).alias("mean_error"))


def backtest_summary(metrics: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Unweighted mean of fold metrics per series; series with no fold → zeros."""
    s = metrics.groupBy(key).agg(F.avg("mape").alias("mean_mape"), F.avg("rmse").alias("mean_rmse"),
                                 F.avg("mae").alias("mean_mae"),
                                 F.avg("directional_accuracy").alias("mean_directional_accuracy"),
                                 F.avg("mean_error").alias("mean_error_bias"),
                                 F.count(F.lit(1)).alias("n_folds"))
    j = keys.join(s, key, "left")
    return j.select(key, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in
                           ["mean_mape", "mean_rmse", "mean_mae", "mean_directional_accuracy", "mean_error_bias"]],
                    F.coalesce("n_folds", F.lit(0)).alias("n_folds"))


def linear_fit(pts: DataFrame, key: str) -> DataFrame:
    """Per series OLS on position: slope, intercept, population std of the
    residuals, n and last position."""
    fit = pts.groupBy(key).agg(F.regr_slope("x", "t").alias("b"), F.regr_intercept("x", "t").alias("a"),
                               F.count(F.lit(1)).alias("n"), F.max("t").alias("t_max"))
    res = pts.join(fit, key).select(key, (F.col("x") - (F.col("a") + F.col("b") * F.col("t"))).alias("r"))
    sd = res.groupBy(key).agg(F.stddev_pop("r").alias("sigma"))
    return fit.join(sd, key)


def linear_forecast(pts: DataFrame, key: str, horizon: int, z: float = 1.96) -> DataFrame:
    f = linear_fit(pts, key)
    g = f.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    t = F.col("t_max") + F.col("step")
    y = F.col("a") + F.col("b") * t
    return g.select(key, "step", t.alias("t"), y.alias("forecast"), (y - z * F.col("sigma")).alias("lower"),
                    (y + z * F.col("sigma")).alias("upper"))


def holdout_eval(pts: DataFrame, key: str, test_size: int, min_train: int = 10) -> DataFrame:
    """Last ``test_size`` points as test, OLS on the rest; MAE, MAPE and R²
    (floored at 0); only series with n ≥ test_size + min_train."""
    n = pts.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    p = pts.join(n, key).filter(F.col("n") >= test_size + min_train)
    train = p.filter(F.col("t") <= F.col("n") - test_size)
    test = p.filter(F.col("t") > F.col("n") - test_size)
    fit = train.groupBy(key).agg(F.regr_slope("x", "t").alias("b"), F.regr_intercept("x", "t").alias("a"))
    tj = test.join(fit, key).withColumn("pred", F.col("a") + F.col("b") * F.col("t"))
    tj = tj.withColumn("_mean", F.avg("x").over(Window.partitionBy(key)))
    err = F.col("x") - F.col("pred")
    g = tj.groupBy(key).agg(F.avg(F.abs(err)).alias("mae"),
                            F.coalesce(F.avg(F.when(F.col("x") != 0, F.abs(err / F.col("x")))) * 100.0,
                                       F.lit(0.0)).alias("mape"),
                            F.sum(err * err).alias("_ssr"),
                            F.sum((F.col("x") - F.col("_mean")) * (F.col("x") - F.col("_mean"))).alias("_sst"))
    r2 = F.greatest(F.lit(0.0), F.lit(1.0) - safe_div(F.col("_ssr"), F.col("_sst")))
    return g.select(key, "mae", "mape", F.coalesce(r2, F.lit(0.0)).alias("r2"))


# ------------------------------------------------------------------ M7 AR order selection
AR_ORDERS = [(p, d) for d in (0, 1) for p in (0, 1, 2)]


def _fit_ar(y: np.ndarray, p: int, d: int):
    z = np.diff(y) if d == 1 else y
    if len(z) <= p + 2:
        return None
    rows = [np.ones(len(z) - p)] + [z[p - j - 1:len(z) - j - 1] for j in range(p)]
    X = np.column_stack(rows)
    target = z[p:]
    coef, *_ = np.linalg.lstsq(X, target, rcond=None)
    resid = target - X @ coef
    m = len(target)
    sse = float(resid @ resid)
    aic = m * np.log(sse / m) + 2 * (p + 1) if sse > 0 else -np.inf
    return coef, aic, z


def ar_forecast_group(key: str, horizon: int):
    """Returns the per-series function for ``applyInPandas``: fits AR(p) on
    the series or its first difference for every (p, d) in AR_ORDERS by
    least squares, keeps the lowest AIC and forecasts ``horizon`` steps."""
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y = pdf["x"].to_numpy(dtype=float)
        best = None
        for p, d in AR_ORDERS:
            r = _fit_ar(y, p, d)
            if r is not None and (best is None or r[1] < best[2]):
                best = (p, d, r[1], r[0], r[2])
        if best is None:
            return pd.DataFrame({key: [], "p": [], "d": [], "aic": [], "step": [], "forecast": []})
        p, d, aic, coef, z = best
        hist = list(z)
        out = []
        level = y[-1]
        for s in range(1, horizon + 1):
            nxt = coef[0] + sum(coef[j + 1] * hist[-j - 1] for j in range(p))
            hist.append(nxt)
            level = level + nxt if d == 1 else nxt
            out.append(level)
        k = pdf[key].iloc[0]
        return pd.DataFrame({key: [k] * horizon, "p": [p] * horizon, "d": [d] * horizon,
                             "aic": [float(aic)] * horizon, "step": list(range(1, horizon + 1)),
                             "forecast": out})
    return fit
