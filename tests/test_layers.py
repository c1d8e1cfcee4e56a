"""Suites by group, health and contract report on literal rows."""

from __future__ import annotations

from pyspark.sql import types as T

from kpiforge.operators.expectations import load_suite, run_suite
from kpiforge.operators.health import contract_report, layer_health
from kpiforge.plans import q_layers
from pyspark.sql import functions as F

ASSETS = "layer string, asset string, n_rows long, latest int"
CONTRACTS = "layer string, artifact string, source string, quality string, confidence double"


def status(spark, assets, contracts, layers=("bronze", "silver", "gold")):
    rows = layer_health(spark.createDataFrame(assets, ASSETS), spark.createDataFrame(contracts, CONTRACTS), list(layers)).collect()
    return {r.layer: (r.status, r.n_assets, r.n_contracts, r.n_rows, r.latest) for r in rows}


def test_health_of_every_kind(spark):
    c = [("bronze", "a", "real", "good", 80.0), ("gold", "g", "real", "good", 80.0)]
    got = status(spark, [("bronze", "a", 5, 1), ("bronze", "b", 0, 9), ("silver", "s", 3, 2), ("gold", "g", 0, 3)], c)
    assert got == {"bronze": ("healthy", 1, 1, 5, 1), "silver": ("warning", 1, 0, 3, 2), "gold": ("empty", 0, 1, 0, None),
                   "overall": ("degraded", 2, 2, 8, 2)}
    assert status(spark, [("bronze", "a", 5, 1)], c, ["bronze"])["overall"] == ("healthy", 1, 1, 5, 1)
    assert status(spark, [("bronze", "a", 5, 1)], c)["silver"] == ("missing", 0, 0, 0, None)
    assert status(spark, [], [])["overall"] == ("critical", 0, 0, 0, None)
    assert status(spark, [("bronze", "a", 0, 1)], [], ["bronze"])["overall"][0] == "critical"


def test_report_counts_sources_and_classes(spark):
    rows = [("bronze", "a", "real", "good", 80.0), ("bronze", "b", "real", "fair", 60.0), ("bronze", "c", "fallback", "fair", 40.0), ("gold", "g", "proxy", "good", 70.0)]
    got = {(r.part, r.layer, r.source, r.quality): (r.n_artifacts, r.avg) for r in contract_report(spark.createDataFrame(rows, CONTRACTS)).collect()}
    assert got == {("all", None, None, None): (4, 62.5), ("layer", "bronze", None, None): (3, 60.0), ("layer", "gold", None, None): (1, 70.0),
                   ("source", "bronze", "real", None): (2, 70.0), ("source", "bronze", "fallback", None): (1, 40.0), ("source", "gold", "proxy", None): (1, 70.0),
                   ("quality", "bronze", None, "good"): (1, 80.0), ("quality", "bronze", None, "fair"): (2, 50.0), ("quality", "gold", None, "good"): (1, 70.0)}
    assert contract_report(spark.createDataFrame([], CONTRACTS)).count() == 0


def test_suite_by_group_equals_each_table_alone(spark):
    """Every group is judged as a table of its own, failures included."""
    df = spark.createDataFrame([("a", 2000, "x", 1.0), ("a", None, "y", 2.0), ("b", 1960, None, 3.0), ("b", 2031, "z", None), ("c", 2001, "x", 1e10)],
                               "asset string, year int, region string, value double")
    suite = load_suite(q_layers.SUITES / "silver_features.json") + [
        {"expectation_type": "expect_column_max_to_be_between", "kwargs": {"column": "value", "max_value": 10}},
        {"expectation_type": "expect_column_values_to_be_unique", "kwargs": {"column": "region"}},
        {"expectation_type": "expect_column_values_to_be_of_type", "kwargs": {"column": "value", "type_": "float"}},
        {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "absent"}}]
    got = run_suite(df, suite, ("asset",), [F.max("year").alias("run_at")]).collect()
    assert {(r.asset, r.run_at) for r in got} == {("a", 2000), ("b", 2031), ("c", 2001)}
    for a in "abc":
        alone = {(r.idx, r.success, r.observed) for r in run_suite(df.filter(F.col("asset") == a), suite).collect()}
        assert {(r.idx, r.success, r.observed) for r in got if r.asset == a} == alone
    ok = {a: [r.success for r in sorted(got, key=lambda r: r.idx) if r.asset == a] for a in "abc"}
    assert ok == {"a": [True, True, False, True, True, True, True, True, False], "b": [True, True, True, False, False, True, True, True, False],
                  "c": [True, True, True, True, True, False, True, True, False]}


def test_schemas_of_the_named_tables(spark):
    """Expectations on schemas look at each asset's own table, not at the union."""
    df = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "asset string, year int, region string")
    schemas = {"a": T._parse_datatype_string("year int, region string, more int"), "b": T._parse_datatype_string("year string, other string")}
    suite = [{"expectation_type": "expect_table_columns_to_match_set", "kwargs": {"column_set": ["year", "region"]}},
             {"expectation_type": "expect_column_values_to_be_of_type", "kwargs": {"column": "year", "type_": "int"}}]
    got = {(r.asset, r.idx): r.success for r in run_suite(df, suite, ("asset",), schemas=schemas).collect()}
    assert got == {("a", 0): True, ("a", 1): True, ("b", 0): False, ("b", 1): False}


def test_every_suite_file_is_one_pass_and_runs(spark):
    names = {p.stem for p in q_layers.SUITES.glob("*.json")}
    assert names == {"bronze_raw_data", "bronze_data_freshness", "silver_features", "gold_kpis"}
    got = q_layers.results(spark, "/root/testdata/sf0.001").collect()
    assert {r.suite for r in got} == names and {r.layer for r in got} == {"bronze", "silver", "gold"}
    assert any(not r.success for r in got) and all(r.run_at is not None for r in got)
    plan = run_suite(q_layers.bronze_rows(spark, "/root/testdata/sf0.001"), load_suite(q_layers.SUITES / "bronze_raw_data.json"), ("asset", "month"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
