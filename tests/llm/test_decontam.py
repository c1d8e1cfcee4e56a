import hashlib
import random
import re
from collections import Counter

import pytest

from kpiforge.llm import decontam, queries
from tests.llm.fixtures import SF, EDGE, documents, edge, empty


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items):
    windows = {}
    for item, t in items:
        w = words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[i:i + n]))):
                    hit |= set(range(i, i + n))
                    found |= x
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def brute_clean(docs, items, length=13):
    """(doc_id, text) of the documents that stay, runs of hit words cut."""
    windows = set()
    for _, t in items:
        w = words(t)
        n = min(13, len(w))
        windows |= {tuple(w[i:i + n]) for i in range(len(w) - n + 1 if w else 0)}
    bad = Counter(r[0] for r in brute(docs, items) if r[5])
    out = []
    for d, t in docs:
        if bad[d]:
            continue
        at = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or ""))
        w, hit = words(t), set()
        assert len(w) == len(at)
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
        runs, i = [], 0
        while i < len(w):
            j = i
            while j in hit:
                j += 1
            if j - i >= length:
                runs.append((at[i].start(), at[j - 1].end()))
            i = j + 1
        for a, b in reversed(runs):
            t = t[:a] + t[b:]
        out.append((d, t))
    return out


def rows(df):
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_query_against_brute_force(spark):
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select("doc_id" if t == "documents" else "item_id", "text").collect()]
    got = rows(queries.QUERIES["op9_decontaminate"](spark, SF))
    assert got == brute(read("documents"), read("benchmark"))
    assert any(r[5] for r in got)


def small(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 5, 12, 13, 14, 30]))) for i in range(12)] + [(3, "b a b b b a"), (40, None), (41, "c C d")]
    docs = [(i, text(rng.randint(0, 60)) + rng.choice(["", " C c D", " x " + items[7][1] + " y"])) for i in range(80)]
    return docs, items


@pytest.mark.parametrize("seed,block", [(0, 10**6), (1, 10**6), (2, 20), (3, 1)])
def test_overlapping_items_over_two_words(spark, seed, block):
    """Repeats, short items, items with the same id, and many blocks."""
    docs, items = small(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find(documents(spark, docs), bench, block_words=block)
    assert rows(decontam.judged(found)) == brute(docs, items)
    kept = decontam.clean(documents(spark, docs), bench, block_words=block)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(brute_clean(docs, items))


@pytest.mark.parametrize("block", [10**6, 40])
def test_item_in_a_long_document_is_cut(spark, block):
    """Below the share the document stays, the item does not; a short whole
    item stays; ``n_chars`` follows the text, other columns are untouched."""
    rng = random.Random(5)
    say = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n))
    item, other = say(40), say(30)
    a, b = say(900), say(900)
    docs = [(1, f"{a}. {item.upper()}! {b}"), (2, f"{a} three short words {b}"), (3, f"{item} {say(20)}"), (4, None), (5, f"{a}\n{other} {b}\n{item}"), (5, b)]
    bench = spark.createDataFrame([(1, item), (2, other), (3, "Three short words")], "item_id long, text string")
    got = sorted((r.doc_id, r.text or "", r.n_chars, r.label) for r in decontam.clean(documents(spark, docs), bench, block_words=block).collect())
    want = [(1, f"{a}. ! {b}"), (2, docs[1][1]), (4, ""), (5, f"{a}\n {b}\n"), (5, b)]
    assert got == sorted((d, t, len(t) if d != 4 else None, "x") for d, t in want)


def test_any_share(spark):
    found = spark.createDataFrame([(i, 40, [(0, i)], ["x"]) for i in range(1, 41)], "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>")
    for share in (0.3, 0.05, 0.325, 0.75, 1.0, 0.01):
        got = {r.doc_id for r in decontam.judged(found, share).filter("contaminated").collect()}
        assert got == {i for i in range(1, 41) if round(i * 1000) >= round(share * 1000) * 40}


def test_cut_spans(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = documents(spark, [(1, "Zero, ONE two; three! four one two THREE"), (2, "é one two")])
    found = decontam.find(docs, bench)
    got = {r.doc_id: r.text for r in decontam.cut_spans(docs, found).collect()}
    assert got == {1: "Zero, ! four ", 2: "é one two"}


def test_edges(spark):
    bench = spark.createDataFrame([(1, "tie tie"), (None, "漢字"), (2, None)], "item_id long, text string")
    got = decontam.judged(decontam.find(edge(spark), bench)).collect()
    assert len(got) == len(EDGE)
    assert {r.doc_id for r in got if r.contaminated} == {7, 8, 10}
    assert decontam.find(empty(spark), bench).count() == 0
    none = bench.filter("item_id = 99")
    assert decontam.judged(decontam.find(edge(spark), none)).filter("n_hit > 0").count() == 0
    assert decontam.clean(edge(spark), none).count() == len(EDGE)
