import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from kpiforge.llm import fmdedup, queries
from tests.llm.fixtures import EDGE, SF, documents, edge, empty


def brute(rows, window=50):
    """{doc: (words, removed, sha256)} by the definition; ids unique."""
    first = {}
    split = {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(split):
        for i in range(len(split[d]) - window + 1):
            first.setdefault(tuple(split[d][i:i + window]), d)
    out = {}
    for d, w in split.items():
        mark = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                mark[i:i + window] = [True] * window
        kept = b" ".join(x for x, m in zip(w, mark) if not m)
        out[d] = (len(w), sum(mark), hashlib.sha256(kept).hexdigest())
    return out


def run(spark, rows):
    got = {}
    for r in fmdedup.dedup(documents(spark, rows)).collect():
        got[r.doc_id] = (r.n_words, sum(s.end - s.start for s in r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
    return got


def random_rows(rng, n=140):
    block = lambda k, a="abc": [rng.choice(a) for _ in range(k)]
    shared = [block(k, "abcdefgh") for k in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(n):
        kind = rng.randrange(7)
        if kind == 0:
            t = ["a"] * rng.randint(0, 200)
        elif kind == 1:
            t = ["a", "b", "c"] * rng.randint(0, 60)
        elif kind == 2:
            t = block(rng.randint(0, 60), "xyz") + rng.choice(shared) + block(rng.randint(0, 60), "xyz") + rng.choice(shared)
        elif kind == 3 and rows:
            t = list(rng.choice(rows)[1])
            for _ in range(min(len(t), 2)):
                t[rng.randrange(len(t))] = "é"
        elif kind == 4 and rows:
            t = rng.choice(rows)[1]
        elif kind == 5:
            t = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(0, 90))] + shared[3]
        else:
            t = block(rng.randint(0, 200), "ab")
        rows.append((i * 11 % n, t))
    gap = lambda: rng.choice([" ", "\n", "  ", "\t"])
    return [(d, "".join(w + gap() for w in t)) for d, t in rows]


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op11_fm_dedup"](spark, SF).collect()}
    assert got == brute(rows)
    assert sum(n for _, n, _ in got.values()) > 0


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_over_a_tiny_alphabet(spark, seed):
    rows = random_rows(random.Random(seed))
    assert run(spark, rows) == brute(rows)


def test_small_shards_and_flushes_change_nothing(spark):
    """Every shard a few anchors, every flush a few units."""
    rows = random_rows(random.Random(7), 80)
    docs = documents(spark, rows)
    old = fmdedup.repeated_windows.__defaults__, fmdedup.shared_anchors.__defaults__
    fmdedup.repeated_windows.__defaults__, fmdedup.shared_anchors.__defaults__ = (3, 50), (4,)
    try:
        got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in fmdedup.dedup(docs).collect()}
    finally:
        fmdedup.repeated_windows.__defaults__, fmdedup.shared_anchors.__defaults__ = old
    assert got == brute(rows)


def test_words_in_pieces():
    rng = random.Random(3)
    texts = ["", "one", "  two words ", "x" * 300, "", *(" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 40))) for _ in range(60)), None, "end"]
    whole = fmdedup.words(*fmdedup.text_buffers(pa.array(texts)))
    for step in (1, 7, 64, 1000):
        got = fmdedup.words(*fmdedup.text_buffers(pa.array(texts)), step=step)
        assert all((a == b).all() for a, b in zip(got, whole))
    assert np.bincount(whole[1], minlength=len(texts)).tolist() == [len((t or "").split()) for t in texts]
    flat = [w for t in texts for w in (t or "").split()]
    assert len(set(whole[0].tolist())) == len(set(flat))


def test_matching_statistics_of_an_index():
    """Longest matches with smaller owners' segments, against plain search."""
    rng = random.Random(4)
    segments = [np.array([rng.randrange(4) for _ in range(rng.randint(1, 40))], np.uint64) for _ in range(60)]
    segments = [segments[i] for i in sorted({tuple(s.tolist()): i for i, s in enumerate(segments)}.values())]
    owner = np.array([rng.randrange(20) for _ in segments])
    index = fmdedup.ShardIndex(segments, owner)
    got = {}
    for lanes, place, length in index.statistics(segments, owner, max(map(len, segments))):
        got.update({(int(a), int(b)): int(c) for a, b, c in zip(lanes, place, length)})
    text = [",".join(map(str, s.tolist())) + "," for s in segments]
    for i, s in enumerate(segments):
        for a in range(len(s)):
            want = 0
            while a + want < len(s) and any(o < owner[i] and ("," + t).find("," + ",".join(map(str, s[a:a + want + 1].tolist())) + ",") >= 0 for o, t in zip(owner, text)):
                want += 1
            assert got[i, a] == want


def test_suffix_order_and_borders():
    rng = random.Random(5)
    text = []
    for end in range(30):
        text += [30 + rng.randrange(3) for _ in range(rng.randint(0, 50))] + [end]
    order, border = fmdedup.suffix_order(np.array(text), 51)
    plain = sorted(range(len(text)), key=lambda i: text[i:])
    assert order.tolist() == plain
    common = lambda a, b: next((k for k in range(len(text)) if text[a + k:a + k + 1] != text[b + k:b + k + 1]), 0)
    assert border.tolist() == [0] + [common(a, b) for a, b in zip(plain, plain[1:])]


def test_edges(spark):
    got = fmdedup.dedup(edge(spark)).collect()
    assert len(got) == len(EDGE)
    assert {r.n_words for r in got if r.doc_id in (2, 3, 5)} == {0}
    same = " ".join(f"w{i}" for i in range(60))
    rows = fmdedup.dedup(documents(spark, [(None, same), (None, same), (4, same), (4, same), (4, "other " + same), (9, same + "\n tail")])).collect()
    removed = sorted((r.doc_id is None, r.doc_id or 0, sum(s.end - s.start for s in r.spans)) for r in rows)
    assert removed == [(False, 4, 0), (False, 4, 0), (False, 4, 0), (False, 9, 60), (True, 0, 60), (True, 0, 60)]
    assert [bytes(r.kept) for r in rows if r.doc_id == 9] == [b"tail"]
    assert fmdedup.dedup(empty(spark)).count() == 0
