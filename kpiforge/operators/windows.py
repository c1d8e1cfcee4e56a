"""Series operators over (entity, time) panels.

All of these run on panels that were aggregated to one row per
(entity, period) first, so a window partition holds one entity's periods,
not its raw rows. Global scalings never use an un-partitioned window
(which would pull every row into one task): they cross join a one-row
aggregate instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import c, num, safe_div


def series_window(by, order) -> Window:
    by = [by] if isinstance(by, str) else list(by)
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*by).orderBy(*[F.col(o).asc_nulls_last() for o in order])


def yoy_pct(x, w: Window) -> Column:
    """(x − lag(x)) / nullif(lag(x), 0) · 100."""
    prev = F.lag(c(x), 1).over(w)
    return safe_div(c(x) - prev, prev) * F.lit(100.0)


def yoy_change(x, w: Window) -> Column:
    return c(x) - F.lag(c(x), 1).over(w)


def pct_change(x, w: Window) -> Column:
    """pandas-style pct_change·100: (x / lag(x) − 1)·100, no fill."""
    prev = F.lag(c(x), 1).over(w)
    return (safe_div(c(x), prev) - F.lit(1.0)) * F.lit(100.0)


def rolling_avg(x, w: Window, n: int = 3) -> Column:
    return F.avg(c(x)).over(w.rowsBetween(-(n - 1), 0))


def rolling_std(x, w: Window, n: int = 3) -> Column:
    """Sample std over the last n rows; NULL with fewer than 2 values."""
    return F.stddev_samp(c(x)).over(w.rowsBetween(-(n - 1), 0))


def cumulative_change(x, w: Window) -> Column:
    """(x / first − 1)·100 against the partition's first row; 0 when first ≤ 0."""
    first = F.first(c(x)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(first <= 0, F.lit(0.0)).otherwise((safe_div(c(x), first) - F.lit(1.0)) * 100.0)


def minmax_scale(df: DataFrame, col: str, out: str, eps: float = 0.01,
                 digits: int = 1, by: list[str] | None = None) -> DataFrame:
    """(x − min)/(max − min + eps)·100 with min/max over the whole frame
    (or per ``by`` group), joined back as a one-row (per group) aggregate."""
    stats = df.groupBy(*(by or [])).agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    j = df.crossJoin(stats) if not by else df.join(stats, by, "left")
    val = (F.col(col) - F.col("_mn")) / (F.col("_mx") - F.col("_mn") + F.lit(eps)) * 100.0
    return j.withColumn(out, num(val, digits)).drop("_mn", "_mx")


def scale_by_max(df: DataFrame, col: str, out: str, eps: float = 0.01, digits: int = 1) -> DataFrame:
    """x / (max(x) + eps)·100 over the whole frame."""
    stats = df.agg(F.max(col).alias("_mx"))
    return (df.crossJoin(stats)
            .withColumn(out, num(F.col(col) / (F.col("_mx") + F.lit(eps)) * 100.0, digits))
            .drop("_mx"))


def dedup_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep row_number() = 1 per key under ``order`` (make it unique)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
