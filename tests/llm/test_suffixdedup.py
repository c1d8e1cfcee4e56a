import hashlib
import random

import numpy as np
import pytest

from kpiforge.llm import queries, suffixdedup
from tests.llm.fixtures import SF, EDGE, documents, edge, empty


def brute(rows, window=50):
    """{doc: (bytes, removed, spans, sha256)} by the definition; ids unique."""
    first = {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            first.setdefault(b[i:i + window], d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        mark = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - window + 1):
            if first[b[i:i + window]] < d:
                mark[i:i + window] = True
        spans = int((mark[1:] < mark[:-1]).sum())
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out[d] = (len(b), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def run(spark, rows):
    got = {}
    for r in suffixdedup.dedup(documents(spark, rows)).collect():
        got[r.doc_id] = (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
    return got


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op6_suffix_dedup"](spark, SF).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_over_a_tiny_alphabet(spark, seed):
    """Periods, overlaps, copies with edits, matches of 49, 50 and 51."""
    rng = random.Random(seed)
    block = lambda n, a="ab": "".join(rng.choice(a) for _ in range(n))
    shared = [block(n, "abcdef") for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(120):
        kind = rng.randrange(6)
        if kind == 0:
            t = "a" * rng.randint(0, 300)
        elif kind == 1:
            t = "abc" * rng.randint(0, 100)
        elif kind == 2:
            t = block(rng.randint(0, 60), "xyz") + rng.choice(shared) + block(rng.randint(0, 60), "xyz") + rng.choice(shared)
        elif kind == 3 and rows:
            t = list(rng.choice(rows)[1] or "")
            for _ in range(min(len(t), 2)):
                t[rng.randrange(len(t))] = "é"
            t = "".join(t)
        elif kind == 4 and rows:
            t = rng.choice(rows)[1]
        else:
            t = block(rng.randint(0, 400))
        rows.append((i * 7 % 120, t))
    assert run(spark, rows) == brute(rows)


def test_parts_of_long_texts(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghijklmnop ") for _ in range(60_000))
    rows = [(1, long), (2, "q" + long[:40_000] + "z" + long[40_100:]), (3, long)]
    old, suffixdedup.PART = suffixdedup.PART, 5_000
    try:
        data = suffixdedup.parts
        import pyarrow as pa

        pieces = list(data(pa.array([t for _, t in rows]), np.array([1, 2, 3])))
        assert len(pieces) > 30
        windows = sum(len(suffixdedup.Units(p[0], p[1]).window_at(np.arange(len(suffixdedup.Units(p[0], p[1]).first)))) for p in pieces)
        assert windows == sum(len(t) - 49 for _, t in rows)
    finally:
        suffixdedup.PART = old
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    got = suffixdedup.dedup(edge(spark)).collect()
    assert len(got) == len(EDGE)
    twice = "the same sixty byte string that two documents have in common, here."
    rows = suffixdedup.dedup(documents(spark, [(None, twice), (None, twice), (4, twice), (4, twice), (4, "other " + twice), (9, twice)])).collect()
    removed = sorted((r.doc_id is None, r.doc_id or 0, sum(s.end - s.start for s in r.spans)) for r in rows)
    n = len(twice)
    assert removed == [(False, 4, 0), (False, 4, 0), (False, 4, 0), (False, 9, n), (True, 0, n), (True, 0, n)]
    assert suffixdedup.dedup(empty(spark)).count() == 0
