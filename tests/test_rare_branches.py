"""Branches that the given tables do not reach."""

from pyspark.sql import functions as F

from kpiforge.plans.q_ops import common_ratio, coverage_issues
from kpiforge.plans.q_quality import bronze_confidence


def test_coverage_issues(spark):
    data = spark.createDataFrame([("A",), ("A",), ("B",)], "region string")
    geo = spark.createDataFrame([("B",), ("C",), ("C",), ("D",)], "region string")
    assert sorted(tuple(r) for r in coverage_issues(data, geo).collect()) == [
        ("duplicate_in_geo", "C"), ("missing_in_data", "C"), ("missing_in_data", "D"), ("missing_in_geo", "A")]


def test_common_ratio_needs_ten_years(spark):
    def series(years, value, name):
        return spark.createDataFrame([(y, value * y) for y in years], f"year long, {name} double")

    ten = common_ratio(series(range(1, 12), 6.0, "a"), series(range(2, 12), 2.0, "b"), "a", "b").collect()
    assert len(ten) == 10 and all(r.is_ratio and r.value == 3.0 for r in ten)
    nine = common_ratio(series(range(1, 10), 6.0, "a"), series(range(1, 12), 2.0, "b"), "a", "b").collect()
    assert len(nine) == 9 and all(not r.is_ratio and r.value == 6.0 * r.year for r in nine)
    zero = common_ratio(series(range(0, 10), 6.0, "a"), series(range(0, 10), 0.0, "b"), "a", "b").collect()
    assert all(r.value is None for r in zero)


def test_bronze_confidence_paths(spark):
    rows = [(0.0, 200, "real", 100.0), (40.0, 5, "real", 70.0), (10.0, 60, "real", 93.0), (0.0, 200, "fallback", 15.0),
            (40.0, 5, "fallback", 10.0), (20.0, 25, "unknown", 26.0), (90.0, 1, "unknown", 15.0)]
    df = spark.createDataFrame(rows, "np double, n int, source string, want double")
    assert df.filter(bronze_confidence(F.col("np"), F.col("n"), F.col("source")) != F.col("want")).collect() == []
