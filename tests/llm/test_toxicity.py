import math
import random

import numpy as np
import pytest

from kpiforge.llm import queries, toxicity
from tests.llm.fixtures import EDGE, documents, edge, empty


def corpus(n=400):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(8)).capitalize()
    rows, labels, bad = [], [], {}
    for i in range(n):
        s = [sentence() for _ in range(rng.randint(3, 20))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            at = rng.randrange(len(s))
            s[at] += " you " + rng.choice(["zzidiot", "zztrash", "zzmoronic"])
            bad[i] = at
        rows.append((i, ". ".join(s) + "."))
        labels.append((i, toxic))
    return rows, labels, bad


def test_learns_from_documents_and_finds_the_sentence(spark):
    rows, labels, bad = corpus()
    docs = documents(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int").filter("doc_id % 3 <> 1")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.learn(docs, marks)).collect()}
    test = [i for i, _ in rows if i % 3 == 1]
    assert all((got[i].predicted == 1) == (i in bad) for i in test)
    for i in test:
        assert [x.number for x in got[i].offending] == ([bad[i]] if i in bad else [])


def test_fit_gradient_is_that_of_the_noisy_or():
    """One bag, one feature: the fitted probability follows the label."""
    data = [(1.0, 2, [[0]]), (0.0, 3, []), (0.0, 1, [[1]]), (1.0, 0, [[0, 1]])] * 20
    bias, w = toxicity.fit(data, 2, steps=800, l2=0.0)
    p = lambda x: 1 / (1 + math.exp(-x))
    assert p(bias + w[0]) > 0.95 and p(bias + w[1]) < 0.1 and p(bias) < 0.05


def test_scorer_is_one_minus_product():
    s = toxicity.Scorer(-3.0, {"bad$": 4.0, "awfu": 2.0})
    score, n, hit = s.score("A bad day. Awful bad! Fine here.\nAnd here")
    p = [1 / (1 + math.exp(-x)) for x in (1.0, 3.0, -3.0, -3.0)]
    assert n == 4 and [h[0] for h in hit] == [0, 1]
    assert score == pytest.approx(1 - np.prod([1 - x for x in p]))


def test_held_out_accuracy_on_given_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op5_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.9 * sum(r.predicted for r in rows)
    assert hit >= 0.75 * sum(r.toxic for r in rows)      # 305 toxic documents to learn from


def test_edges(spark):
    rows, labels, _ = corpus(60)
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (5, 1), (5, 0)], "doc_id long, toxic int")
    model = toxicity.learn(documents(spark, rows), marks)
    got = toxicity.score(edge(spark), model).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (2, 3)} == {0.0}
    assert toxicity.score(empty(spark), model).count() == 0
    none = toxicity.learn(documents(spark, rows), marks.filter("doc_id < 0"))
    assert none[1] == {}
    assert toxicity.learn(documents(spark, rows), marks.filter("toxic = 0"))[1] == {}
