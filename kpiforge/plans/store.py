"""Materialised intermediate tables in the shared folder.

Small derived tables that many plans read (the panel views: one row per
region × period) are written once per Spark application as Parquet under
``spark.checkpoint.dir`` and read back. That cuts their lineage (a lost
executor re-reads the files instead of recomputing the fact-table
aggregations) and lets every consumer share one computation instead of
re-scanning the fact tables per branch.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

_paths: dict[tuple[str, str, str], str] = {}
_frames: dict[tuple[str, str, str], DataFrame] = {}
_locks: dict[tuple[str, str, str], threading.Lock] = {}
_guard = threading.Lock()


def materialized(spark: SparkSession, sf: str, name: str,
                 build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """Build once per application; concurrent callers wait for the one build."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"), name)
    df = _frames.get(key)
    if df is not None:
        return df
    with _guard:
        lock = _locks.setdefault(key, threading.Lock())
    with lock:
        df = _frames.get(key)
        if df is None:
            path = _paths.get(key)
            if path is None:
                path = scratch_path(spark, name)
                build(spark, sf).write.mode("errorifexists").parquet(path)
                _paths[key] = path
            df = _frames[key] = spark.read.parquet(path)
    return df


def forget(spark: SparkSession | None = None) -> None:
    """Drop the registry (files stay; the folder is the cluster's)."""
    if spark is None:
        _paths.clear()
        _frames.clear()
        return
    app = spark.sparkContext.applicationId
    for d in (_paths, _frames):
        for k in [k for k in d if k[0] == app]:
            del d[k]
