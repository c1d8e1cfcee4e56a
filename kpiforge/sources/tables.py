"""Readers for the input tables.

Every reader selects only the columns the caller asks for, so the Parquet
scan's ``ReadSchema`` stays narrow and Catalyst can push filters into it.
Dimension tables are broadcast only behind a row-count check
(``bounded_broadcast``); anything above the bound is joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Largest row count we are willing to replicate to every executor. The two
# geography dimensions (5 and 25 rows) are far below it; customer, supplier
# and part grow with the data and normally fail the check.
BROADCAST_MAX_ROWS = 100_000

_size_checks: dict[tuple[int, str], bool] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def bounded_broadcast(df: DataFrame, key: str | None = None,
                      max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows.

    The check is a ``limit(max_rows + 1).count()`` (it stops reading early)
    and is remembered per session under ``key``. Above the bound the frame
    is returned unchanged and the join falls back to a shuffle join.
    """
    spark = df.sparkSession
    cache_key = (id(spark), key) if key else None
    ok = _size_checks.get(cache_key) if cache_key else None
    if ok is None:
        ok = df.limit(max_rows + 1).count() <= max_rows
        if cache_key:
            _size_checks[cache_key] = ok
    return F.broadcast(df) if ok else df


def nation_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation key → region name (the panel's region)."""
    df = table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    return bounded_broadcast(df, key=f"{sf_dir}/nation")


def region_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "region", "r_regionkey", "r_name")
    return bounded_broadcast(df, key=f"{sf_dir}/region")
