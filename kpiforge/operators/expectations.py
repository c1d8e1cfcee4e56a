"""Expectation suites compiled to one aggregate pass (D12, D12a–i).

A suite is a list of ``{"expectation_type": ..., "kwargs": {...}}``. All
data-dependent statistics of the suite are computed by a single ``agg``
over the table; schema-only expectations are decided from ``df.schema``.
The result has one row per expectation: expectation_type, column,
success, observed. Unknown expectation types raise (they do not pass).
With ``by``, one grouped pass judges every group of rows as a table of its
own. Suites are JSON files (:func:`load_suite`).
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Dtype → class names used by the type expectation.
TYPE_CLASS = {"int": "int", "int64": "int", "int32": "int", "float": "float", "float64": "float",
              "float32": "float", "str": "object", "string": "object", "object": "object",
              "bool": "bool", "boolean": "bool", "datetime": "datetime", "datetime64": "datetime"}


def spark_type_class(dt: T.DataType) -> str:
    if isinstance(dt, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "int"
    if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    if isinstance(dt, T.StringType):
        return "object"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return dt.simpleString()


DATA_TYPES = {"expect_table_row_count_to_be_between", "expect_column_values_to_not_be_null",
              "expect_column_values_to_be_between", "expect_column_values_to_be_in_set",
              "expect_column_values_to_be_unique", "expect_column_max_to_be_between",
              "expect_column_values_to_match_regex"}
SCHEMA_TYPES = {"expect_table_columns_to_match_set", "expect_table_columns_to_match_ordered_list",
                "expect_column_values_to_be_of_type"}


def _num(col: str):
    return F.col(col).cast("string").try_cast("double")


def load_suite(path: str | Path) -> list[dict]:
    """The expectations of a suite file."""
    return json.loads(Path(path).read_text())["expectations"]


def run_suite(df: DataFrame, suite: list[dict], by: tuple[str, ...] = (), keep=(),
              schemas: dict[str, T.StructType] | None = None) -> DataFrame:
    """One row per expectation (and group of the columns ``by``). ``keep``
    are further aggregates of a group that go into each of its rows.
    ``schemas``: the tables that the values of ``by[0]`` name, for the
    expectations on schemas; by default the schema of ``df``."""
    cols = set(df.columns)
    keep = list(keep)
    kept = [*by, *(df.agg(*keep).columns if keep else [])]

    def by_schema(test):
        if schemas is None:
            return F.lit(test(df.schema))
        return F.col(by[0]).isin([a for a, s in schemas.items() if test(s)])

    aggs, rows = [], []
    for i, exp in enumerate(suite):
        et, kw = exp["expectation_type"], exp.get("kwargs", {})
        col = kw.get("column")
        if et not in DATA_TYPES | SCHEMA_TYPES:
            raise ValueError(f"unknown expectation type: {et}")
        if et in SCHEMA_TYPES:
            if et == "expect_table_columns_to_match_set":
                ok = by_schema(lambda s: set(kw.get("column_set", [])) <= set(s.names))
            elif et == "expect_table_columns_to_match_ordered_list":
                ok = by_schema(lambda s: s.names == list(kw.get("column_list", [])))
            else:
                want = TYPE_CLASS.get(str(kw.get("type_", kw.get("expected_type", ""))).lower())

                def typed(s):
                    have = spark_type_class(s[col].dataType) if col in s.names else None
                    return have is not None and (have == want or (want == "float" and have == "int"))
                ok = by_schema(typed)
            rows.append((i, et, col, ok, F.lit(None).cast("double")))
            continue
        if col is not None and col not in cols:
            rows.append((i, et, col, F.lit(False), F.lit(None).cast("double")))
            continue
        k = f"_e{i}"
        if et == "expect_table_row_count_to_be_between":
            aggs.append(F.count(F.lit(1)).alias(k))
            n = F.col(k)
            lo, hi = kw.get("min_value", 0), kw.get("max_value")
            ok = F.lit(True)
            if lo is not None:
                ok = ok & (n >= lo)
            if hi is not None:
                ok = ok & (n <= hi)
            rows.append((i, et, None, ok, n.cast("double")))
        elif et == "expect_column_values_to_not_be_null":
            aggs += [F.count(F.col(col)).alias(k), F.count(F.lit(1)).alias(k + "n")]
            frac = F.col(k) / F.col(k + "n")
            ok = F.when(F.col(k + "n") == 0, True).otherwise(frac >= kw.get("mostly", 1.0))
            rows.append((i, et, col, ok, F.when(F.col(k + "n") > 0, frac)))
        elif et == "expect_column_values_to_be_between":
            v = _num(col)
            lo, hi = kw.get("min_value"), kw.get("max_value")
            bad = F.lit(False)
            if lo is not None:
                bad = bad | (v < lo)
            if hi is not None:
                bad = bad | (v > hi)
            aggs.append(F.count_if(v.isNotNull() & bad).alias(k))
            rows.append((i, et, col, F.col(k) == 0, F.col(k).cast("double")))
        elif et == "expect_column_values_to_be_in_set":
            vs = list(kw.get("value_set", []))
            aggs.append(F.count_if(F.col(col).isNotNull() & ~F.col(col).isin(*vs)).alias(k))
            rows.append((i, et, col, F.col(k) == 0, F.col(k).cast("double")))
        elif et == "expect_column_values_to_be_unique":
            aggs += [F.count_distinct(F.col(col)).alias(k), F.count(F.col(col)).alias(k + "n")]
            ratio = F.col(k) / F.col(k + "n")
            ok = F.when(F.col(k + "n") == 0, True).otherwise(ratio >= kw.get("mostly", 1.0))
            rows.append((i, et, col, ok, F.when(F.col(k + "n") > 0, ratio)))
        elif et == "expect_column_max_to_be_between":
            aggs.append(F.max(_num(col)).alias(k))
            m = F.col(k)
            ok = F.lit(True)
            if kw.get("min_value") is not None:
                ok = ok & (m >= kw["min_value"])
            if kw.get("max_value") is not None:
                ok = ok & (m <= kw["max_value"])
            rows.append((i, et, col, F.when(m.isNull(), True).otherwise(ok), m))
        elif et == "expect_column_values_to_match_regex":
            aggs.append(F.count_if(F.col(col).isNotNull() & ~F.col(col).cast("string").rlike(kw["regex"])).alias(k))
            rows.append((i, et, col, F.col(k) == 0, F.col(k).cast("double")))
    if by:
        base = df.groupBy(*by).agg(*keep, *aggs) if keep or aggs else df.select(*by).distinct()
    else:
        base = df.agg(*keep, *aggs) if keep or aggs else df.sparkSession.range(1).select()
    structs = [F.struct(F.lit(i).alias("idx"), F.lit(et).alias("expectation_type"),
                        F.lit(col).cast("string").alias("column"), ok.alias("success"),
                        obs.cast("double").alias("observed"))
               for i, et, col, ok, obs in rows]
    return base.select(*kept, F.inline(F.array(*structs)))
