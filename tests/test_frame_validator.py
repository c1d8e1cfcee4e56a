"""Levels of the frame validator."""

import pytest

from kpiforge.plans.q_quality import merge_validations, validate_frame

SCHEMA = {"a": (True, "integer", 0.0, 10.0), "b": (True, "float", None, None), "c": (True, "string", None, None), "d": (False, "datetime", None, None)}


def run(df, level):
    return {(r.column_name, r.check_name): (r.violations, r.severity) for r in validate_frame(df, SCHEMA, level).collect()}


def test_levels(spark):
    df = spark.createDataFrame([(1, "1.5", "2024-01-01"), (-1, "x", "no date"), (11, None, None), (None, None, None)], "a int, b string, d string")
    moderate = run(df, "moderate")
    assert moderate == {("a", "null"): (1, "error"), ("a", "min"): (1, "error"), ("a", "max"): (1, "error"), ("b", "null"): (2, "error"), ("c", "missing"): (1, "error")}
    strict = run(df, "strict")
    assert strict[("b", "type")] == (1, "error") and strict[("d", "type")] == (1, "error") and strict[("a", "type")] == (0, "ok")
    mostly = spark.createDataFrame([(1, None, "x"), (2, None, "y"), (3, "1", "z")], "a int, b string, c string")
    assert run(mostly, "moderate")[("b", "null")] == (2, "warning")
    assert run(mostly, "lenient")[("b", "null")] == (2, "error")
    with pytest.raises(ValueError):
        validate_frame(df, SCHEMA, "severe")


def test_merge(spark):
    good = spark.createDataFrame([(1, "1", "x")], "a int, b string, c string")
    bad = spark.createDataFrame([(99, "1", "x")], "a int, b string, c string")
    m = [tuple(merge_validations(*[validate_frame(f, SCHEMA) for f in fs]).first()) for fs in ((good,), (good, bad))]
    assert m == [(True, 0, 0), (False, 1, 0)]
