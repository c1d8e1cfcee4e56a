import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from kpiforge.llm import queries, vectorcodes
from tests.llm.fixtures import CLASH, SF

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                       *[T.StructField(c, T.StringType()) for c in CLASH if c != "label"], T.StructField("vector", T.StringType())])


def brute(rows, entries=256, rounds=4):
    """{(vec_id, n-th): ...} by plain Python integers; rows: (id, vector, label)."""
    def order(r):
        return r[0] is None, r[0] or 0, [-math.inf if x is None else x for x in r[1] or []]

    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in sorted(rows, key=order) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // 4
    part = lambda v, p: v[p * width:(p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(4)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def near(x, book):
        return min((dist(x, c), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            got = {}
            for _, v, _ in kept:
                got.setdefault(near(part(v, p), books[p])[1], []).append(part(v, p))
            for k, own in got.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by = [], {}
    for i, v, lab in kept:
        best = [near(part(v, p), books[p]) for p in range(4)]
        error = sum(d for d, _ in best)
        by[lab] = by.get(lab, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in best), error, lab))
    return sorted(((i, c, e, by[lab], digest) for i, c, e, lab in out), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, *["x"] * (len(SCHEMA) - 3)) for i, v, lab in rows], SCHEMA)


def run(spark, rows):
    return sorted((tuple(r) for r in vectorcodes.codes(table(spark, rows)).collect()), key=str)


def test_transform_keeps_squared_distances():
    rng = np.random.default_rng(3)
    for width in (1, 2, 3, 5, 8, 13, 16):
        a, b = rng.integers(-999, 999, (2, 7, width))
        p = 1 << (width - 1).bit_length()
        ta, tb = vectorcodes.transform(a), vectorcodes.transform(b)
        assert ta.shape == (7, p)
        assert (np.square(ta - tb).sum(1) == p * np.square(a - b).sum(1)).all()
    # Sequency: the k-th function changes its sign k times.
    rows = vectorcodes.transform(np.eye(16, dtype=np.int64)).T
    assert [(r[1:] != r[:-1]).sum() for r in rows] == list(range(16))


def test_search_is_exact_with_ties_to_the_lower_index():
    rng = np.random.default_rng(5)
    for width, most in ((3, 3), (16, 200), (1, 5)):
        rows, book = rng.integers(-most, most, (300, width)), rng.integers(-most, most, (40, width))
        index, d, work = vectorcodes.nearest(vectorcodes.transform(rows), vectorcodes.transform(book))
        full = np.square(rows[:, None] - book[None]).sum(2)
        assert (index == full.argmin(1)).all() and (d == full.min(1)).all()
    assert work < 300 * 40 * 1 + 1


def test_entries_are_eliminated_early():
    rng = np.random.default_rng(6)
    centre = rng.integers(-3000, 3000, (256, 16))
    rows = centre[rng.integers(0, 256, 2000)] + rng.integers(-20, 20, (2000, 16))
    _, _, work = vectorcodes.nearest(vectorcodes.transform(rows), vectorcodes.transform(centre))
    assert work < 0.25 * 2000 * 256 * 16


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op13_walsh_codes"](spark, SF).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("seed", range(2))
def test_small_vectors_with_ties(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(400)]), [rng.choice([-2, -1, 0, 1, 2]) / 1024 + rng.choice([0, 0.0004]) for _ in range(12)], rng.choice([None, 0, 1])) for _ in range(500)]
    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    bad = [(1, None, 0), (2, [None, 1.0, 1.0, 1.0], 0), (3, [float("nan"), 0.0, 0.0, 0.0], 1), (4, [float("inf"), 0.0, 0.0, 0.0], 1), (5, [-float("inf")] * 4, None)]
    good = [(7, [0.5, -0.5, 0.25, 0.0], None), (7, [0.5, -0.5, 0.25, 0.0], None), (None, [1.0, -1.0, 0.0, 0.0], 2), (9, [0.5, -0.5, 0.25, 0.001], 2)]
    assert run(spark, bad + good) == brute(bad + good)
    assert run(spark, bad) == [] and run(spark, []) == []
    # Empty vectors, and vectors of another length.
    assert [r[1:4] for r in run(spark, [(1, [], 0), (2, [], 0)])] == [("00000000", 0, 0)] * 2
    mixed = [(1, [1.0, 2.0, 3.0], 0), (2, [1.0, 2.0, 3.0, 0.0, 0.0], 0), (3, [], None)]
    padded = [(i, v + [0.0] * (8 - len(v)), lab) for i, v, lab in mixed]
    assert run(spark, mixed) == brute(padded)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(1, [1e30] * 4, 0)])
