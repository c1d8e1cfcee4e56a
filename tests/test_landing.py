import datetime
import os

import pytest
from pyspark.sql import functions as F

from kpiforge.operators.landing import judged, landed, overall, source_quality

NOW = datetime.datetime(2026, 5, 1, 12)
FILES = {
    "a_good.json": (b'{"metadata": null, "features": []}', 0, 0, []),
    "a_list.json": (b' [1, {"x": 2}]\n', 30, 0, []),
    "a_old.json": (b'{"metadata": {}, "data": [1]}', 37, 7, ["37 days old"]),
    "a_older.json": (b'{"metadata": {}}', 400, 30, ["no data or features", "400 days old"]),
    "b_cut.json": (b'{"metadata": {}, "data": [1', 90, 15, ["invalid JSON"]),
    "b_cut_list.json": (b'[1, 2', 0, 15, ["invalid JSON"]),
    "b_blank.json": (b" \n", 0, 15, ["invalid JSON"]),
    "b_word.json": (b"pending", 0, 15, ["invalid JSON"]),
    "b_bytes.json": (b'{"metadata": "\xff\xfe", "data": 1}', 90, 10, ["unreadable"]),
    "b_bare.json": (b"{}", 0, 15, ["no metadata", "no data or features"]),
    "c_number.json": (b"-1.5e3", 0, 0, []),
    "c_text.json": (b'"a \\"b\\""', 0, 0, []),
}


@pytest.fixture
def files(spark, tmp_path):
    for name, (content, age, _, _) in FILES.items():
        p = tmp_path / name
        p.write_bytes(content)
        t = (NOW - datetime.timedelta(days=age)).replace(tzinfo=datetime.UTC).timestamp()
        os.utime(p, (t, t))
    (tmp_path / "b_no_bytes.json").write_bytes(b"")        # no row: see landed()
    f = landed(spark, str(tmp_path), "*.json").withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    return judged(f, F.lit(NOW)).withColumn("source", F.substring("name", 1, 1))


def test_each_fault_of_a_file(files):
    got = {r["name"]: (r.penalty, r.issues) for r in files.collect()}
    assert got == {n: (p, i) for n, (_, _, p, i) in FILES.items()}


def test_sources(spark, files):
    want = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("c",)], "source string")
    q = source_quality(files, want)
    got = {r.source: (r.status, r.file_count, r.n_faulty, r.worst_penalty, r.quality_score) for r in q.collect()}
    assert got == {"a": ("poor", 4, 2, 30, 43), "b": ("poor", 6, 6, 15, 0), "c": ("present", 2, 0, 0, 80), "d": ("missing", 0, 0, 0, 0)}
    assert overall(q).first()[:] == (3, 1, 41.0)


def test_no_files(spark, files):
    want = spark.createDataFrame([("x",)], "source string")
    assert source_quality(files.limit(0), want).first().status == "missing"
    assert overall(source_quality(files, want.limit(0))).first()[:] == (0, 0, None)
