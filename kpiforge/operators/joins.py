"""Join operators beyond a single equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_time: str,
                  right_time: str, values: list[str], flag: str | None = None) -> DataFrame:
    """For each left row, the right row of the same ``by`` key with the
    greatest ``right_time <= left_time`` (backward as-of join).

    Formulated as a union of both sides ordered by (key, time) with the
    right rows first on equal time, and ``last_value(ignore nulls)`` over
    the running frame — one sort per key, no range join and no pairs.
    Left rows keep all their columns; unmatched ones get NULL values.
    """
    tag_cols = [f"_r_{v}" for v in values]
    l_cols = left.columns
    l = left.select(*[F.col(x) for x in l_cols],
                    F.col(left_time).alias("_t"), F.lit(1).alias("_side"),
                    *[F.lit(None).alias(t) for t in tag_cols])
    r = right.select(*[F.lit(None).alias(x) if x not in by else F.col(x) for x in l_cols],
                     F.col(right_time).alias("_t"), F.lit(0).alias("_side"),
                     F.lit(True).alias("_hit"),
                     *[F.col(v).alias(t) for v, t in zip(values, tag_cols)])
    l = l.withColumn("_hit", F.lit(None).cast("boolean"))
    u = l.unionByName(r.select(l.columns))
    # Right rows with equal time are ordered by their values, so the match
    # is the same on every task retry.
    w = (Window.partitionBy(*by).orderBy(F.col("_t").asc_nulls_first(), "_side",
                                         *[F.col(t).asc_nulls_first() for t in tag_cols])
         .rowsBetween(Window.unboundedPreceding, 0))
    # _hit marks a right row; carrying it lets NULL right values stay NULL
    # instead of falling back to an older right row.
    last_hit = F.last(F.when(F.col("_side") == 0, F.struct(*tag_cols)), ignorenulls=True).over(w)
    out = u.withColumn("_m", last_hit).filter(F.col("_side") == 1)
    extra = [F.col("_m").isNotNull().alias(flag)] if flag else []
    return out.select(*l_cols, *[F.col(f"_m.{t}").alias(v) for v, t in zip(values, tag_cols)], *extra)


def full_outer_chain(base: DataFrame, parts: list[tuple[DataFrame, list[str]]],
                     key_cols: list[str]) -> DataFrame:
    """Chained FULL OUTER joins keyed on the *first* table's keys only
    (``a.year = t.year``), the way a CTE chain ``a full join b on a.k = b.k
    full join c on a.k = c.k`` behaves: rows of later tables that miss
    ``a`` never meet each other. Output key = coalesce over all tables.

    Every frame must carry its keys with a unique prefix (``<p>_<key>``);
    ``parts`` lists (frame, keys it joins on). ``base`` uses prefix ``a``.
    """
    out = base
    for df, on in parts:
        p = df.columns[0].split("_", 1)[0]
        cond = None
        for k in on:
            e = F.col(f"a_{k}") == F.col(f"{p}_{k}")
            cond = e if cond is None else cond & e
        out = out.join(df, cond, "full_outer")
    return out


def asof_backward_bucketed(left: DataFrame, right: DataFrame, by: list[str], left_time: str,
                           right_time: str, values: list[str], bucket) -> DataFrame:
    """Backward as-of join that does not put a whole key into one task.

    ``bucket`` maps a time column to a coarse bucket (e.g. ``F.to_date``).
    1. Inside each (key, bucket): ``asof_backward`` partitioned by
       (key, bucket) — a hot key is spread over its buckets.
    2. Carry-in for left rows with no earlier right row in their own
       bucket: the last right row of each (key, bucket) (``max_by``), and a
       window over those per-bucket summaries — one row per key × bucket,
       bounded by the time span, not by the row count — gives the latest
       right row of any *earlier* bucket.
    Exact; right rows win ties on equal time.
    """
    lb = left.withColumn("_bkt", bucket(F.col(left_time)))
    rb = right.withColumn("_bkt", bucket(F.col(right_time)))
    within = asof_backward(lb, rb, by + ["_bkt"], left_time, right_time, values, flag="_hit")

    rstruct = F.struct(*[F.col(v).alias(v) for v in values])
    last_per_bucket = rb.groupBy(*by, "_bkt").agg(F.max_by(rstruct, F.col(right_time)).alias("_last"))
    keys = lb.select(*by, "_bkt").distinct()
    # Left bucket markers sort before the same bucket's right summary, so the
    # frame "all earlier rows" holds only strictly earlier buckets' summaries.
    u = (keys.select(*by, "_bkt", F.lit(0).alias("_side"),
                     F.lit(None).cast(last_per_bucket.schema["_last"].dataType).alias("_last"))
         .unionByName(last_per_bucket.select(*by, "_bkt", F.lit(1).alias("_side"), "_last")))
    w = Window.partitionBy(*by).orderBy("_bkt", "_side").rowsBetween(Window.unboundedPreceding, -1)
    carry = (u.withColumn("_prev", F.last("_last", ignorenulls=True).over(w))
             .filter(F.col("_side") == 0).select(*by, "_bkt", "_prev"))
    out = within.join(carry, by + ["_bkt"], "left")
    cols = [c for c in left.columns]
    return out.select(*cols, *[F.when(F.col("_hit"), F.col(v)).otherwise(F.col(f"_prev.{v}")).alias(v)
                               for v in values])
