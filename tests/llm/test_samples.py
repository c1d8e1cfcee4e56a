from kpiforge.llm import secrets, toxicity, urls
from kpiforge.llm.common import label_sample
from tests.llm.fixtures import documents


def test_rare_labels_and_copies(spark):
    """Five rare positives among 3,000 stay in a sample of 100; copies are
    one row; weights sum up to the rows of each label."""
    rows = [(f"k{i}", 0.0) for i in range(2995)] + [("same", 0.0)] * 500 + [(f"p{i}", 1.0) for i in range(5)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, y double")
    got = label_sample(df, ["k"], "y", 100).collect()
    assert len(got) == len({r.k for r in got}) == 100
    assert {r.k for r in got if r.y == 1} == {f"p{i}" for i in range(5)}
    assert all(r.weight == 1 for r in got if r.y == 1)
    assert abs(sum(r.weight for r in got if r.y == 0) - 3495) < 1e-6
    whole = {(r.k, r.y): r.weight for r in label_sample(df, ["k"], "y", 10_000).collect()}
    assert len(whole) == 3001 and whole["same", 0.0] == 500 and whole["p1", 1.0] == 1
    assert label_sample(df.filter("y > 1"), ["k"], "y", 10).count() == 0
    assert {r.y for r in label_sample(df.filter("y = 1"), ["k"], "y", 4).collect()} == {1.0}


def test_rare_toxic_documents_are_learnt(spark):
    rows = [(i, "vile rotten words here" if i < 8 else f"plain words number {i}") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i < 8)) for i in range(600)], "doc_id long, toxic int")
    got = toxicity.training_rows(documents(spark, rows), labels, 40).collect()
    assert sum(r.toxic for r in got) == 8 and len(got) == 40


def test_forest_with_rare_secrets(spark):
    base = dict.fromkeys(secrets.FEATURES, 0.0)
    rows = [{**base, "f_len": 4.0 + i % 7, "f_digit": 0.01 * (i % 50), "label": 0} for i in range(2000)] + [{**base, "f_len": 5.0, "f_digit": 0.4 + i / 100, "f_key": 1.0, "label": 1} for i in range(6)]
    found = spark.createDataFrame([tuple(r[c] for c in [*secrets.FEATURES, "label"]) for r in rows], ", ".join(f"{c} double" for c in secrets.FEATURES) + ", label int")
    got = secrets.classify(found, found, sample=60).collect()
    assert {r.score > 0.5 for r in got if r.label == 1} == {True} and sum(r.score > 0.5 for r in got if r.label == 0) == 0


def test_block_rates_never_see_the_own_host(spark):
    """A labelled url of a suffix that only its host has gets the neutral rate."""
    rows = [(f"h{i}.s{i}", f"s{i}", i % urls.FOLDS, i % 2) for i in range(40)] + [(f"x{i}.net", "net", i % urls.FOLDS, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "host string, suffix1 string, fold int, label int")
    got = {(r.suffix1, r.fold): r for r in urls.suffix_stats(df, 1).collect()}
    assert all(abs(r.other - 0.5) < 1e-12 for (s, _), r in got.items() if s != "net")
    assert all(abs(r["all"] - 50 / 60) < 1e-12 and abs(r.other - 45 / 55) < 1e-12 for (s, _), r in got.items() if s == "net")
