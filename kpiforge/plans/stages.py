"""Pipeline runner: the medallion stages with independent models submitted
concurrently (the orchestrated variant of the reference: sources in
parallel, then features, then dashboards).

Independent Spark jobs are started from a thread pool so the scheduler
overlaps them; each stage waits for its inputs. Tables are materialised
through the store, so a stage never recomputes an earlier one.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from . import panel
from .features import SILVER, silver

PANELS = ["region_sums", "order_panel", "tourism_panel", "rent_panel", "month_panel"]
SILVER_INDEPENDENT = [s for s in SILVER if s != "unified_base"]


def _parallel(fns, workers: int = 8):
    with ThreadPoolExecutor(max_workers=workers) as ex:
        for f in [ex.submit(fn) for fn in fns]:
            f.result()


def silver_tables(spark: SparkSession, sf: str, names) -> None:
    """Writes the panels and the silver tables of these names, all submitted
    at once; the store's per-table lock makes a silver table wait only for
    the panels it reads (each built once), so short chains finish while the
    median runs."""
    _parallel([lambda p=p: getattr(panel, p)(spark, sf) for p in PANELS]
              + [lambda s=s: silver(spark, sf, s) for s in names], workers=16)


def run_stages(spark: SparkSession, sf: str, gold=None, contracts=None) -> dict[str, float]:
    """Run bronze→silver→gold(→contracts); returns seconds per stage.
    ``gold`` / ``contracts`` are callables that force one output each."""
    t = {}
    t0 = time.perf_counter()
    silver_tables(spark, sf, SILVER_INDEPENDENT)
    silver(spark, sf, "unified_base")
    t["silver"] = time.perf_counter() - t0
    if gold:
        t1 = time.perf_counter()
        _parallel(gold)
        t["gold"] = time.perf_counter() - t1
    if contracts:
        t2 = time.perf_counter()
        _parallel(contracts)
        t["contracts"] = time.perf_counter() - t2
    return t
