"""Forecast and back-test queries (M1–M8) over monthly revenue per region
and over the quarterly rent feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import exact_sum_value, num, safe_div
from ..operators import arma as ARMA
from ..operators import forecast as FC
from ..oracle.silver import N, REV, with_silver
from . import panel
from .features import silver
from .registry import query
from .store import materialized

MIN_TRAIN, HORIZON, STEP = 24, 3, 1
RENT_MIN_TRAIN, RENT_HORIZON = 8, 2
LIN_HORIZON, TEST_SIZE = 6, 6


def build_region_month(spark: SparkSession, sf: str) -> DataFrame:
    """(region, year, month) revenue from the shared region sums."""
    return panel.region_sums(spark, sf).select("region", "year", "month", exact_sum_value("revenue").cast("double").alias("revenue"))


def region_month(spark, sf):
    return materialized(spark, sf, "region_month", build_region_month)


def revenue_points(spark, sf):
    return FC.positions(region_month(spark, sf), "region", ["year", "month"], "revenue")


def rent_points(spark, sf):
    return FC.positions(silver(spark, sf, "rent_income"), "region", ["year", "quarter"], "median_weekly_rent")


RM_CTE = f""", rm AS (SELECT n_name AS region, year(l_shipdate) AS year, month(l_shipdate) AS month, CAST(SUM({REV}) AS DOUBLE) AS revenue
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3),
pts AS (SELECT region, row_number() OVER (PARTITION BY region ORDER BY year, month) AS t, revenue AS x FROM rm WHERE revenue IS NOT NULL)"""
RENT_CTE = """, pts AS (SELECT region, row_number() OVER (PARTITION BY region ORDER BY year, quarter) AS t, median_weekly_rent AS x
  FROM rent_income WHERE median_weekly_rent IS NOT NULL)"""


def _bt_sql(min_train, h, step) -> str:
    return f""", g0 AS (SELECT *, (x - lag(x) OVER w) / NULLIF(lag(x) OVER w, 0) AS g FROM pts WINDOW w AS (PARTITION BY region ORDER BY t)),
g1 AS (SELECT *, avg(g) OVER (PARTITION BY region ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gm,
              count(*) OVER (PARTITION BY region) AS n FROM g0),
folds AS (SELECT region, t AS train_end, x AS last, gm FROM g1 WHERE t >= {min_train} AND t + {h} <= n AND (t - {min_train}) % {step} = 0),
steps AS (SELECT f.*, r.i, f.last * pow(1 + CASE WHEN f.train_end >= 2 THEN COALESCE(f.gm, 0) ELSE 0 END, r.i) AS pred
          FROM folds f CROSS JOIN range(1, {h + 1}) AS r(i)),
fc AS (SELECT s.*, p.x AS actual FROM steps s JOIN pts p ON p.region = s.region AND p.t = s.train_end + s.i),
fc2 AS (SELECT *, sign(actual - lag(actual) OVER w) AS da, sign(pred - lag(pred) OVER w) AS dp FROM fc
        WINDOW w AS (PARTITION BY region, train_end ORDER BY i)),
fm AS (SELECT region, train_end,
  COALESCE(avg(CASE WHEN actual <> 0 THEN abs((actual - pred) / actual) END) * 100, 0) AS mape,
  sqrt(avg((actual - pred) * (actual - pred))) AS rmse, avg(abs(actual - pred)) AS mae,
  {'50.0' if h < 2 else 'avg(CASE WHEN da IS NOT NULL THEN CASE WHEN da = dp THEN 100.0 ELSE 0.0 END END)'} AS directional_accuracy,
  avg(actual - pred) AS mean_error FROM fc2 GROUP BY 1, 2),
bs AS (SELECT k.region, COALESCE(avg(mape), 0) AS mean_mape, COALESCE(avg(rmse), 0) AS mean_rmse, COALESCE(avg(mae), 0) AS mean_mae,
  COALESCE(avg(directional_accuracy), 0) AS mean_directional_accuracy, COALESCE(avg(mean_error), 0) AS mean_error_bias,
  count(fm.region) AS n_folds
  FROM (SELECT DISTINCT region FROM pts) k LEFT JOIN fm ON fm.region = k.region GROUP BY k.region)"""


def _fold_cols(df):
    return df.select("region", "train_end", num("mape", 6).alias("mape"), num("rmse", 4).alias("rmse"),
                     num("mae", 4).alias("mae"), num("directional_accuracy", 4).alias("directional_accuracy"),
                     num("mean_error", 4).alias("mean_error"))


def _summary_cols(df):
    return df.select("region", num("mean_mape", 6).alias("mean_mape"), num("mean_rmse", 4).alias("mean_rmse"),
                     num("mean_mae", 4).alias("mean_mae"),
                     num("mean_directional_accuracy", 4).alias("mean_directional_accuracy"),
                     num("mean_error_bias", 4).alias("mean_error_bias"), "n_folds")


_FOLD_SEL = (f"SELECT region, train_end, {N('mape', 6)} AS mape, {N('rmse', 4)} AS rmse, {N('mae', 4)} AS mae, "
             f"{N('directional_accuracy', 4)} AS directional_accuracy, {N('mean_error', 4)} AS mean_error FROM fm")
_SUM_SEL = (f"SELECT region, {N('mean_mape', 6)} AS mean_mape, {N('mean_rmse', 4)} AS mean_rmse, {N('mean_mae', 4)} AS mean_mae, "
            f"{N('mean_directional_accuracy', 4)} AS mean_directional_accuracy, {N('mean_error_bias', 4)} AS mean_error_bias, n_folds FROM bs")


@query("backtest_folds", with_silver(RM_CTE + _bt_sql(MIN_TRAIN, HORIZON, STEP) + "\n" + _FOLD_SEL))
def backtest_folds(spark, sf):
    """M1 + M2: walk-forward folds with their metrics, all series at once."""
    pts = revenue_points(spark, sf)
    fc = FC.walk_forward(pts, "region", HORIZON, MIN_TRAIN, STEP)
    return _fold_cols(FC.fold_metrics(fc, "region", HORIZON))


@query("backtest_summary", with_silver(RM_CTE + _bt_sql(MIN_TRAIN, HORIZON, STEP) + "\n" + _SUM_SEL))
def backtest_summary(spark, sf):
    """M3: unweighted mean of the fold metrics per series (zeros if none)."""
    pts = revenue_points(spark, sf)
    fm = FC.fold_metrics(FC.walk_forward(pts, "region", HORIZON, MIN_TRAIN, STEP), "region", HORIZON)
    return _summary_cols(FC.backtest_summary(fm, pts.select("region").distinct(), "region"))


@query("backtest_by_key", with_silver(RENT_CTE + _bt_sql(RENT_MIN_TRAIN, RENT_HORIZON, 1) + "\n" + _SUM_SEL))
def backtest_by_key(spark, sf):
    """M4: back-test of a feature column (weekly rent) by key (region)."""
    pts = rent_points(spark, sf)
    fm = FC.fold_metrics(FC.walk_forward(pts, "region", RENT_HORIZON, RENT_MIN_TRAIN, 1), "region", RENT_HORIZON)
    return _summary_cols(FC.backtest_summary(fm, pts.select("region").distinct(), "region"))


_LIN = """, fit AS (SELECT region, regr_slope(x, t) AS b, regr_intercept(x, t) AS a, count(*) AS n, max(t) AS t_max FROM pts GROUP BY region),
sd AS (SELECT p.region, stddev_pop(p.x - (f.a + f.b * p.t)) AS sigma FROM pts p JOIN fit f ON f.region = p.region GROUP BY p.region)"""


@query("linear_forecast", with_silver(RM_CTE + _LIN + f"""
SELECT f.region, r.step, f.t_max + r.step AS t, {N('f.a + f.b * (f.t_max + r.step)', 2)} AS forecast,
  {N('f.a + f.b * (f.t_max + r.step) - 1.96 * s.sigma', 2)} AS lower, {N('f.a + f.b * (f.t_max + r.step) + 1.96 * s.sigma', 2)} AS upper
FROM fit f JOIN sd s ON s.region = f.region CROSS JOIN range(1, {LIN_HORIZON + 1}) AS r(step)"""))
def linear_forecast(spark, sf):
    """M5: linear trend forecast with a 1.96·σ(residual) band."""
    lf = FC.linear_forecast(revenue_points(spark, sf), "region", LIN_HORIZON)
    return lf.select("region", F.col("step").cast("bigint").alias("step"), F.col("t").cast("bigint").alias("t"),
                     num("forecast", 2).alias("forecast"), num("lower", 2).alias("lower"), num("upper", 2).alias("upper"))


_HOLD = f""", hn AS (SELECT p.*, count(*) OVER (PARTITION BY region) AS n FROM pts p),
htr AS (SELECT region, regr_slope(x, t) AS b, regr_intercept(x, t) AS a FROM hn WHERE n >= {TEST_SIZE} + 10 AND t <= n - {TEST_SIZE} GROUP BY region),
hp AS (SELECT hn.region, hn.x, f.a + f.b * hn.t AS pred, avg(hn.x) OVER (PARTITION BY hn.region) AS m
       FROM hn JOIN htr f ON f.region = hn.region WHERE hn.n >= {TEST_SIZE} + 10 AND hn.t > hn.n - {TEST_SIZE}),
hold AS (SELECT region, avg(abs(x - pred)) AS mae,
  COALESCE(avg(CASE WHEN x <> 0 THEN abs((x - pred) / x) END) * 100, 0) AS mape,
  COALESCE(GREATEST(0.0, 1 - sum((x - pred) * (x - pred)) / NULLIF(sum((x - m) * (x - m)), 0)), 0) AS r2
  FROM hp GROUP BY region)"""


@query("holdout_eval", with_silver(RM_CTE + _HOLD + f"\nSELECT region, {N('mae', 4)} AS mae, {N('mape', 6)} AS mape, {N('r2', 6)} AS r2 FROM hold"))
def holdout_eval(spark, sf):
    """M6: hold-out of the last points; MAE, MAPE, R² floored at 0."""
    h = FC.holdout_eval(revenue_points(spark, sf), "region", TEST_SIZE)
    return h.select("region", num("mae", 4).alias("mae"), num("mape", 6).alias("mape"), num("r2", 6).alias("r2"))


@query("forecast_report", with_silver(RM_CTE + _LIN + _HOLD + f"""
SELECT f.region, p_last.x AS current_value,
  {N('(p_last.x - p_prev.x) / NULLIF(p_prev.x, 0) * 100', 4)} AS growth_yoy_pct,
  {N('f.a + f.b * (f.t_max + 1)', 2)} AS next_forecast,
  {N('COALESCE(h.r2, 0)', 6)} AS r2,
  {N('GREATEST(40, LEAST(90, 60 + 30 * COALESCE(h.r2, 0)))', 2)} AS confidence,
  f.n AS data_points, y.y0 AS year_min, y.y1 AS year_max
FROM fit f JOIN pts p_last ON p_last.region = f.region AND p_last.t = f.t_max
LEFT JOIN pts p_prev ON p_prev.region = f.region AND p_prev.t = f.t_max - 12
LEFT JOIN hold h ON h.region = f.region
JOIN (SELECT region, min(year) AS y0, max(year) AS y1 FROM rm GROUP BY region) y ON y.region = f.region"""))
def forecast_report(spark, sf):
    """M8: per series — current value, YoY growth, next linear forecast,
    hold-out R², confidence clamp(40, 90, 60 + 30·R²), points, year range."""
    pts = revenue_points(spark, sf)
    fit = FC.linear_fit(pts, "region")
    hold = FC.holdout_eval(pts, "region", TEST_SIZE).select("region", "r2")
    last = pts.select("region", F.col("t").alias("t_max"), F.col("x").alias("current_value"))
    prev = pts.select("region", (F.col("t") + 12).alias("t_max"), F.col("x").alias("_prev"))
    yr = region_month(spark, sf).groupBy("region").agg(F.min("year").alias("year_min"), F.max("year").alias("year_max"))
    j = (fit.join(last, ["region", "t_max"]).join(prev, ["region", "t_max"], "left")
         .join(hold, "region", "left").join(yr, "region"))
    r2 = F.coalesce("r2", F.lit(0.0))
    return j.select("region", "current_value",
                    num(safe_div(F.col("current_value") - F.col("_prev"), F.col("_prev")) * 100.0, 4).alias("growth_yoy_pct"),
                    num(F.col("a") + F.col("b") * (F.col("t_max") + 1), 2).alias("next_forecast"),
                    num(r2, 6).alias("r2"),
                    num(F.greatest(F.lit(40.0), F.least(F.lit(90.0), 60 + 30 * r2)), 2).alias("confidence"),
                    F.col("n").alias("data_points"), F.col("year_min").cast("bigint").alias("year_min"),
                    F.col("year_max").cast("bigint").alias("year_max"))


@query("ar_forecast")
def ar_forecast(spark, sf):
    """M7: order-selected autoregressive forecast per series (AIC over
    p ∈ 0..2, d ∈ 0..1), fitted per region with ``applyInPandas`` — one
    series per group, groups spread over the cluster."""
    pts = revenue_points(spark, sf)
    schema = "region string, p int, d int, aic double, step int, forecast double"
    return pts.groupBy("region").applyInPandas(FC.ar_forecast_group("region", LIN_HORIZON), schema)


@query("arima_forecast")
def arima_forecast(spark, sf):
    """M7: forecast per series by the ARIMA order (p, q in 0..2, d in 0..1)
    of least AIC, moving-average terms included."""
    return revenue_points(spark, sf).groupBy("region").applyInPandas(ARMA.forecast_group("region", LIN_HORIZON), "region string, " + ARMA.SCHEMA)
