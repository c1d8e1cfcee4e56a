import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kpiforge.llm import probminhash as pmh, queries
from tests.llm.fixtures import SF, EDGE, documents, edge, empty


def shingles(t):
    w = (t or "").encode().lower().split()
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jp(a, b):
    if not a or not b:
        return float(not a and not b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a if d in b)


def brute(docs, least=0.8):
    """{doc: least id of its class} over all pairs."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (not sets[i] and not sets[j]) or (sets[i].keys() & sets[j].keys() and jp(sets[i], sets[j]) >= least - 1e-9):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: low[find(i)] for i, (d, _) in enumerate(docs)}


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.QUERIES["op10_probminhash"](spark, SF).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute(docs)
    assert {r.doc_id for r in rows if r.first} == set(brute(docs).values())


def test_similarity_equals_definition():
    rng = random.Random(1)
    for _ in range(50):
        a, b = (Counter(rng.choices(range(12), k=rng.randint(1, 15))) for _ in "ab")
        ka, kb = sorted(a), sorted(b)
        got = pmh.similarity(np.array(ka), np.array([a[k] for k in ka], float), np.array(kb), np.array([b[k] for k in kb], float))
        assert got == pytest.approx(jp(a, b))


def test_registers_agree_with_probability_jaccard():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    for swaps in (3, 12, 40):
        other = list(base)
        for i in rng.sample(range(300), swaps):
            other[i] = "x" + other[i]
        texts = [" ".join(base) + " " + " ".join(base[:80]), " ".join(other) + " " + " ".join(other[:80])]
        sig = pmh.signatures(*pmh.shingles(pa.array(texts))[:3], 2, 4096)
        assert (sig[0] == sig[1]).mean() == pytest.approx(jp(shingles(texts[0]), shingles(texts[1])), abs=0.04)


def near_copies(seed, groups=6, size=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    docs = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(40, 160))]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            docs.append(" ".join(t))
            if rng.random() < 0.2:
                docs.append(docs[-1])
            base = t if rng.random() < 0.3 else base        # chains drift away from their start
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_and_chains_of_near_copies(spark, seed):
    docs = near_copies(seed)
    got = {r.doc_id: r.class_id for r in pmh.classes(documents(spark, docs)).collect()}
    assert got == brute(docs)


def test_deduplicated_keeps_one_whole_row_of_each_class(spark):
    docs = near_copies(3, 3, 10)
    df = documents(spark, [*docs, docs[0], docs[0]])
    out = pmh.deduplicated(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(brute(docs).values()))


def test_components_of_a_long_chain(spark):
    n = 60
    order = list(range(n))
    random.Random(0).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.component for r in pmh.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n)}, 100: 100, 101: 100, 102: 100}


def test_edges(spark):
    got = pmh.classes(edge(spark)).collect()
    assert len(got) == len(EDGE)
    assert {r.class_id for r in got if r.doc_id in (2, 3, 5)} == {2}         # texts without words
    assert {r.class_id for r in got if r.doc_id in (7, 8)} == {7}
    assert sum(r.first for r in got) == len({r.class_id for r in got if r.class_id is not None}) + 2   # a null id alone, and two classes of id 9
    assert pmh.classes(empty(spark)).count() == 0
    assert pmh.deduplicated(empty(spark)).count() == 0
