"""Named queries: name → (spark, sf_dir) -> DataFrame, plus oracle SQL.

Modules register their queries with ``@query(name, sql)``; ``sql`` is the
DuckDB reference text (None for operators with no SQL form, which get a
rows-only check).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


MODULES = ["q_silver", "gold", "calculators", "q_ops", "q_quality", "q_display", "q_forecast",
           "q_sources", "q_monitor", "q_records", "q_layers", "q_catalog", "q_landing"]


def load_all() -> None:
    """Import every module that registers queries."""
    for mod in MODULES:
        importlib.import_module(f"{__package__}.{mod}")
