"""Aggregate operators that need more than one built-in function.

``exact_median`` selects by buckets: a histogram over fixed ranges finds
the range that holds the middle, and only that range's values are counted
one by one. Rows are never shuffled or written, only counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_div
from ..session import scratch_path
from ..sources.tables import bounded_broadcast

STEPS = 64                   # ranges for each factor e
_WIDE = 100_000              # more ranges than doubles need on either side of 0


def value_range(v: Column) -> Column:
    """Number of the fixed range of a double: ranges are equal on a
    logarithmic scale, the same for all data, and in the order of values."""
    side = F.floor(F.ln(F.abs(v)) * STEPS).cast("int")
    return (F.when(F.isnan(v), 3 * _WIDE).when(v == 0, 0).when(F.abs(v) == float("inf"), F.when(v > 0, 2 * _WIDE).otherwise(-2 * _WIDE))
            .when(v > 0, side + _WIDE).otherwise(-side - _WIDE))


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median", weight: str | None = None) -> DataFrame:
    """Exact median per group (mean of the two middle values when even).

    ``weight``: how often a row counts. Two passes over ``df``: the first
    counts rows by group and range (summed in each task, so what is shuffled
    hangs on groups and ranges, not on rows), the second counts only the
    values in the range or two of each group that hold the middle, summed in
    each task too: a group of equal values is one row. The ranges to look at
    are written once (the first pass is not run again to count them),
    broadcast behind a check of their number, and joined beyond it.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v"), *([weight] if weight else [])).filter(F.col("_v").isNotNull()).withColumn("_range", value_range(F.col("_v")))

    def on(right, more=()):
        return reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, *more)])

    ranges = rows.groupBy(*keys, "_range").agg(n.alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_range"))
    total = F.sum("_c").over(Window.partitionBy(*keys))
    # 1-based middle ranks: (n + 1) div 2 and n div 2 + 1.
    k1, k2 = F.expr("(_n + 1) div 2"), F.expr("_n div 2 + 1")
    middle = (ranges.withColumn("_upto", upto).withColumn("_n", total).filter((F.col("_upto") >= k1) & (F.col("_upto") - F.col("_c") < k2))
              .select(*keys, "_range", (F.col("_upto") - F.col("_c")).alias("_before"), "_n"))
    path = scratch_path(df.sparkSession, "median_ranges")
    middle.write.parquet(path)
    middle = df.sparkSession.read.schema(middle.schema).parquet(path)
    inside = rows.alias("l").join(bounded_broadcast(middle).alias("r"), on(middle, ["_range"])).select("l.*", "r._before", "r._n")
    counted = inside.groupBy(*keys, "_range", "_before", "_n", "_v").agg(n.alias("_c"))
    last = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_range").orderBy("_v"))
    counted = counted.withColumn("_last", last)

    def at(k):
        return F.max(F.when((k <= F.col("_last")) & (k > F.col("_last") - F.col("_c")), F.col("_v")))

    return counted.groupBy(*keys).agg(((at(k1) + at(k2)) / 2).alias(out))


def safe_corr(x: str, y: str):
    """Pearson correlation as cov_pop / (sd_pop·sd_pop), NULL when constant.

    Only pairwise-complete rows count (both values non-NULL). Plain
    ``corr`` raises under ANSI mode on constant input.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xx = F.when(both, F.col(x))
    yy = F.when(both, F.col(y))
    return safe_div(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))
