"""Panels on rows of their own: exact sums, and work that does not grow with suppliers."""

import datetime as dt
from collections import defaultdict
from decimal import Decimal

from pyspark.sql import functions as F

from kpiforge.functions.scalar import whole
from kpiforge.operators.aggregates import exact_median
from kpiforge.plans import panel, store


def _tables(spark, d, suppliers):
    """``suppliers`` suppliers of two nations with a line in each of three months; one supplier
    stands twice, one has no nation, and some lines have no supplier."""
    sf = str(d)
    day = [dt.datetime(2001, 12, 31, 23), dt.datetime(2002, 1, 1), dt.datetime(2002, 2, 1)]
    supp = [(i, i % 2) for i in range(suppliers)] + [(0, 1), (suppliers, None)]
    lines = [(s, x, 10.25 + i, 0.05, 0.02, "R" if i else None) for s in [*range(suppliers + 1), None, -1] for i, x in enumerate(day)]
    for name, rows, schema in [
            ("nation", [(0, "A", 0), (1, "B", 0), (2, "C", 0)], "n_nationkey int, n_name string, n_regionkey int"),
            ("supplier", supp, "s_suppkey long, s_nationkey int"),
            ("lineitem", lines, "l_suppkey long, l_shipdate timestamp, l_extendedprice double, l_discount double, l_tax double, l_returnflag string")]:
        spark.createDataFrame(rows, schema).write.parquet(f"{sf}/{name}.parquet")
    return sf, supp, lines


def test_line_panels_hold_no_row_for_each_supplier(spark, tmp_path):
    sf, supp, lines = _tables(spark, tmp_path, 40)
    spend, month = defaultdict(Decimal), defaultdict(lambda: [0, 0, 0])
    for s, x, price, disc, *_, flag in lines:
        value = Decimal(str(price)) * (1 - Decimal(str(disc)))
        for k, n in supp:
            if k == s and n is not None:
                spend["AB"[n], x.year] += round(value, 4)
        m = month[x.year, x.month]
        m[0] += 1
        m[1] += 5
        m[2] += flag == "R"
    assert {(r.region, r.year): r.spend for r in panel.tourism_panel(spark, sf).collect()} == dict(spend)
    got = panel.month_panel(spark, sf).collect()
    assert {(r.year, r.month): [r.n_lines, r.disc_h, r.n_returns] for r in got} == dict(month)
    # Every table written on the way has at most regions x months rows.
    sizes = {k[2]: v.count() for k, v in store._frames.items() if k[1] == sf}
    assert max(sizes.values()) <= 3 * 3, sizes


def test_lines_stay_where_they_are_read(spark, tmp_path, monkeypatch):
    """Also where the supplier files are above Spark's broadcast threshold; beyond SUPPLIERS the rows are the same."""
    sf, *_ = _tables(spark, tmp_path, 40)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = {}
        for most in (panel.SUPPLIERS, 0):
            monkeypatch.setattr(panel, "SUPPLIERS", most)
            for build in (panel.build_region_sums, lambda s, d: panel.line_regions(s, d, "l_shipdate")):
                df = build(spark, sf)
                assert ("SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()) == (most == 0)
                rows.setdefault(most, []).append(sorted(map(str, df.collect())))
        assert rows[0] == rows[max(rows)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_exact_median_reads_its_rows_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(1000).selectExpr("id % 3 k", "cast(id as double) v").mapInArrow(count, "k long, v double")
    assert {r.k: r["median"] for r in exact_median(rows, ["k"], "v").collect()} == {0: 499.5, 1: 499.0, 2: 500.0}
    assert seen.value == 2000


def test_whole_is_round_half_away_from_zero(spark):
    xs = [0.0, -0.0, 0.5, -0.5, 1.5, -1.5, 2.5, -2.5, 0.49999999999999994, -0.49999999999999994, 4503599627370495.5, 4503599627370497.0,
          -9007199254740993.0, 1e15 + 0.5, 10.075 * 100, 1.005 * 1000, 8.5 - 1e-15, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert all(a == b for a, b in df.select(whole("x"), F.round("x").cast("bigint")).collect())
