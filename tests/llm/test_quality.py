import random

from kpiforge.llm import quality, queries
from tests.llm.fixtures import SF, EDGE, documents, edge, empty


def brute(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op3_quality_rules"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        n, chars, sym, dup, rep = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, sym, dup, rep)
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (r.base_failed and r.kept)


def corpus(n=600, bad=40):
    rng = random.Random(5)
    lexicon = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = lambda: " ".join(rng.choice(lexicon) for _ in range(rng.randint(30, 300))).capitalize() + "."
    rows = [(i, text(), "en", "hot" if i % 3 else "s") for i in range(n)]
    rows += [(n + i, " ".join(w + "###" for w in text().split()), "en", "hot") for i in range(bad)]
    rows += [(n + bad + i, text().upper().replace(" ", "!! "), "en", "hot") for i in range(bad)]
    return rows, n


def test_outliers_go_and_clean_documents_stay(spark):
    rows, n = corpus()
    kept = {r.doc_id: r.kept for r in quality.judge(documents(spark, rows), min_group=100).collect()}
    assert all(kept[i] for i in range(n))
    assert not any(kept[i] for i in range(n, len(rows)))


def test_small_groups_share_a_wider_estimate(spark):
    rows, _ = corpus(260, 0)
    rows += [(1000 + i, "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf", "de", f"t{i}") for i in range(5)]
    got = quality.judge(documents(spark, rows), min_group=150, steps=1).select("doc_id", "estimate").collect()
    names = {r.doc_id: r.estimate for r in got}
    assert names[1].startswith("s:en") and names[0].startswith("l:en") and names[1000] == "all"
    assert len(got) == len(rows)


def test_salted_join_equals_broadcast(spark):
    rows, _ = corpus(300, 20)
    a = {r.doc_id: r.kept for r in quality.judge(documents(spark, rows), min_group=100, steps=1).collect()}
    old, quality.BROADCAST_GROUPS = quality.BROADCAST_GROUPS, 0
    try:
        b = {r.doc_id: r.kept for r in quality.judge(documents(spark, rows), min_group=100, steps=1).collect()}
    finally:
        quality.BROADCAST_GROUPS = old
    assert a == b


def test_kept_is_the_same_verdict_on_whole_rows(spark):
    rows, _ = corpus(300, 20)
    docs = documents(spark, rows)
    want = {r.doc_id for r in quality.judge(docs, min_group=100, steps=1).filter("kept").collect()}
    out = quality.kept(docs, min_group=100, steps=1)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == want


def test_edges(spark):
    got = quality.judge(edge(spark), steps=1).collect()
    assert len(got) == len(EDGE)
    assert all(r.base_failed for r in got if r.doc_id in (2, 3, 5))
    assert quality.kept(edge(spark)).columns == edge(spark).columns
    assert quality.judge(empty(spark), steps=1).count() == 0
    assert quality.kept(empty(spark), steps=1).count() == 0


def test_concentration_steps_read_one_table(spark, monkeypatch):
    """The joins that deal the rows to their groups run once, not in every step's plan."""
    plans = []

    def mcd(rows, *args):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return real(rows, *args)

    real = quality.mcd
    monkeypatch.setattr(quality, "mcd", mcd)
    words = ["all these words are said in a quiet tone by someone", "others are shouted at passers by from far away there"]
    rows = [(i, f"{words[i % 2]} {i} " * (1 + i % 3), ("en", "de")[i % 2], f"s{i % 4 if i < 40 else i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert quality.judge(docs, min_group=10).count() == 60
    assert len(plans) == 1 and "Join" not in plans[0] and "Union" not in plans[0]


def test_a_task_needs_one_python_worker(spark, monkeypatch):
    """Maps that follow each other in a stage take a worker each, which Spark keeps for later stages."""
    def most(plan, maps=0):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return most(plan.initialPlan(), maps)
        maps = 0 if "Exchange" in name else maps + (name == "MapInArrow")
        each = plan.children()
        return max([maps, *(most(each.apply(i), maps) for i in range(each.size()))])

    found = []

    def written(df, name):
        found.append((name, most(df._jdf.queryExecution().executedPlan())))
        return real(df, name)

    real = quality.written
    monkeypatch.setattr(quality, "written", written)
    rows, _ = corpus(120, 20)
    for groups in (quality.BROADCAST_GROUPS, 0):
        monkeypatch.setattr(quality, "BROADCAST_GROUPS", groups)
        out = quality.kept(documents(spark, rows), min_group=50, steps=2)
        found.append(("kept", most(out._jdf.queryExecution().executedPlan())))
    assert {n for n, _ in found} >= {"quality_rows", "mcd_estimate", "mcd", "kept"}
    assert max(n for _, n in found) == 1, found
