"""Catalog of stored files, search and lineage on literal rows."""

from __future__ import annotations

from kpiforge.operators.catalog import enriched, lineage, scan, search

ENTRY = "name string, layer string, columns array<string>"
CONTRACT = "name string, source string, confidence double, parents array<string>, notes string"


def sample(spark):
    e = spark.createDataFrame([("raw_rents", "bronze", ["a", "b"]), ("rent", "silver", ["year"]), ("kpis", "gold", ["name"]), ("lone", "gold", ["x"])], ENTRY)
    c = spark.createDataFrame([("rent", "real", 90.0, ["raw_rents", "gone"], "weekly RENT survey"), ("kpis", "proxy", 70.0, ["rent", "rent"], None),
                               ("nowhere", "real", 1.0, ["rent"], None)], CONTRACT)
    return enriched(e, c)


def test_scan_reads_files_only(spark, tmp_path):
    spark.range(0, 100, 1, 4).selectExpr("id AS k", "id % 3 AS v").write.parquet(str(tmp_path / "a"))
    spark.range(5).write.parquet(str(tmp_path / "b"))
    spark.range(5).filter("id > 9").write.parquet(str(tmp_path / "none"))
    tables = [(layer, n, spark.read.parquet(str(tmp_path / n))) for layer, n in (("bronze", "a"), ("silver", "b"), ("gold", "none"))]
    df = scan(tables)
    got = {r.name: r for r in df.collect()}
    assert {n: (r.layer, r.row_count, r.column_count, r.columns) for n, r in got.items()} == {
        "a": ("bronze", 100, 2, ["k", "v"]), "b": ("silver", 5, 1, ["id"]), "none": ("gold", 0, 1, ["id"])}
    files = list((tmp_path / "a").glob("*.parquet"))
    assert got["a"].n_files == len(files) == 4 and got["a"].size_bytes == sum(f.stat().st_size for f in files)
    assert got["a"].updated_at is not None and got["none"].updated_at is None and got["none"].n_files == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan and "ReadSchema: struct<k" not in plan and "ReadSchema: struct<id" not in plan


def test_entries_without_contract(spark):
    got = {r.name: r for r in sample(spark).collect()}
    assert set(got) == {"raw_rents", "rent", "kpis", "lone"}
    assert (got["lone"].source, got["lone"].confidence, got["lone"].parents, got["lone"].description) == ("unknown", 0.0, [], "gold table of x")
    assert got["raw_rents"].tags == ["bronze", "unknown", "raw", "rents"] and got["rent"].description == "weekly RENT survey"


def test_search_by_name_description_tag_and_layer(spark):
    find = lambda *a: sorted(r.name for r in search(sample(spark), *a).collect())
    assert find("RENT") == ["raw_rents", "rent"] and find("rent", "silver") == ["rent"]
    assert find("survey") == ["rent"] and find("proxy") == ["kpis"] and find("absent") == [] and find("gold") == ["kpis", "lone"]


def test_lineage_resolves_to_entries(spark):
    got = {tuple(r) for r in lineage(sample(spark)).collect()}
    assert got == {("rent", "upstream", "raw_rents", "bronze", 0.0), ("kpis", "upstream", "rent", "silver", 90.0),
                   ("raw_rents", "downstream", "rent", "silver", 90.0), ("rent", "downstream", "kpis", "gold", 70.0)}
    assert lineage(sample(spark)).count() == 4
