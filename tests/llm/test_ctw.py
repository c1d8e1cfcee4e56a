import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiforge.llm import ctw, queries
from tests.llm.fixtures import SF, edge, empty


def naive(train, texts, depth, kept):
    """log10 probabilities by the textbook recursion over (context, bits)
    nodes of the tree of kept contexts; other contexts under a node are one
    leaf."""
    count = defaultdict(lambda: [0, 0])
    pad = b"\xff" * depth

    def steps(text):
        s = pad + text + b"\xff"
        for i in range(depth, len(s)):
            path = [b""]
            while len(path) <= depth and s[i - len(path):i] in kept:
                path.append(s[i - len(path):i])
            # the leaf shared by the rest of the last kept context
            nodes = path if len(path) == depth + 1 else [*path, path[-1] + b"|rest"]
            bits = format(s[i], "08b")
            for j in range(8):
                yield [(c, bits[:j]) for c in nodes], int(bits[j])

    for t in train:
        for nodes, bit in steps(t):
            for n in nodes:
                count[n][bit] += 1

    def log_kt(n):
        a, b = count[n]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    kids = defaultdict(list)
    for c in kept:
        if c:
            kids[c[1:]].append(c)

    memo = {}

    def log_pw(n):
        if n not in memo:
            c, bits = n
            if c.endswith(b"|rest") or len(c) == depth:
                memo[n] = log_kt(n)
            else:
                split = sum(log_pw((k, bits)) for k in kids[c]) + log_kt((c + b"|rest", bits))
                memo[n] = np.logaddexp(log_kt(n), split) - math.log(2)
        return memo[n]

    def one(nodes):
        n = nodes[0]
        a, b = count[n]
        own = (b + .5) / (a + b + 1)
        if len(nodes) == 1:
            return own
        w = math.exp(log_kt(n) - math.log(2) - log_pw(n))
        return w * own + (1 - w) * one(nodes[1:])

    out = []
    for t in texts:
        total = 0.0
        for nodes, bit in steps(t):
            p = one(nodes)
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def contexts(texts, depth, least):
    """Contexts of at most ``depth`` bytes seen ``least`` times or more."""
    seen = Counter()
    for t in texts:
        s = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(s)):
            seen.update(s[i - d:i] for d in range(1, depth + 1))
    return {b""} | {c for c, n in seen.items() if n >= least}


TRAIN = [b"abracadabra abracadabra", b"the cat sat on the mat", b"", "né à né".encode(), b"aaaa", b"the cat sat on the mat"]
TEXTS = [b"abra", b"", b"the hat", "zé".encode(), b"aaaaaaaaaaaa the cat", b"\x01q"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t.decode(), False) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean")


@pytest.mark.parametrize("depth,least", [(3, 1), (4, 3), (5, 2), (7, 1)])
def test_scores_equal_textbook_recursion(spark, depth, least):
    got = ctw.score(frame(spark, TEXTS), frame(spark, TRAIN), depth=depth, least=least).orderBy("doc_id").collect()
    assert [r.score for r in got] == pytest.approx(naive(TRAIN, TEXTS, depth, contexts(TRAIN, depth, least)), abs=1e-4)


def test_probabilities_of_a_context_sum_to_one(spark):
    counts = ctw.gram_counts(frame(spark, TRAIN), 4)
    wanted = [(int.from_bytes(c + bytes([x]), "big"),) for c in (b"abra", b"e ca", b"zzat", b"\xff\xff\xff\xff", b"qqqq") for x in range(256)]
    asked = spark.createDataFrame(wanted, "gram long").withColumn("n", F.lit(0).cast("long"))
    sums = ctw.gram_scores(counts, asked, 4, 2).groupBy((F.col("gram") / 256).cast("long")).agg(F.sum(F.exp("logp")).alias("p")).collect()
    assert [r.p for r in sums] == pytest.approx([1.0] * 5, abs=1e-5)


def test_blocks_and_groups_do_not_change_scores(spark, monkeypatch):
    """Tiny blocks and groups taken one by one, and one long text."""
    texts = [*TEXTS, b"the cat sat " * 150_000, b"more"]
    whole = ctw.score(frame(spark, texts), frame(spark, TRAIN), depth=4).orderBy("doc_id").collect()
    monkeypatch.setattr(ctw, "GROUP", 1)
    cut = ctw.score(frame(spark, texts), frame(spark, TRAIN), depth=4, block_mb=0).orderBy("doc_id").collect()
    assert [r.score for r in cut] == pytest.approx([r.score for r in whole], rel=1e-6)
    assert [r.n_bytes for r in cut] == [len(t) for t in texts]


def test_without_training_a_byte_costs_eight_bits(spark):
    docs = frame(spark, TEXTS)
    for r in ctw.score(docs, docs.limit(0), depth=4).collect():
        assert r.score == pytest.approx(-8 * (r.n_bytes + 1) * math.log10(2), rel=1e-6)


def test_depth_is_checked(spark):
    docs = frame(spark, TEXTS)
    with pytest.raises(ValueError):
        ctw.score(docs, docs, depth=8)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 10 == 0 for d in docs}
    count = Counter(w for d in docs if not held[d.doc_id] for w in ctw.words((d.text or "").encode()))
    total, distinct = sum(count.values()), len(count)
    got = {r.doc_id: r for r in queries.QUERIES["op1_ctw_score"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        w = ctw.words((d.text or "").encode())
        r = got[d.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d.doc_id], len(w), sum(x in count for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + .1) / (total + .1 * (distinct + 1))) for x in w), rel=1e-9)
    test = [r for r in got.values() if r.held_out and r.n_bytes]
    # Far below the 8 bits of no model, though the tree has seen 0.4 MB only.
    assert sum(r.bits_per_byte * r.n_bytes for r in test) / sum(r.n_bytes for r in test) < 2.6


def test_held_out_text_scores_above_the_word_base(spark):
    test = queries.QUERIES["op1_ctw_score"](spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r.score for r in test) > sum(r.base_score for r in test)


@pytest.mark.parametrize("most,least", [(0, 8), (1, 7), (2, 7), (3, 2), (5, 2), (6, 1), (99, 1)])
def test_the_most_frequent_words_are_common(spark, most, least):
    counts = spark.createDataFrame([(str(i).encode(), c) for i, c in enumerate([7, 2, 2, 1, 1, 1])], "token binary, c long")
    assert ctw.common_from(counts, most) == least
    assert ctw.common_from(counts.limit(0), most) == 1


def test_base_score_does_not_hang_on_the_broadcast(spark, monkeypatch):
    """Rare words come back as lists with their text, one row a text, and are joined."""
    written, held = ctw.written, {}
    monkeypatch.setattr(ctw, "written", lambda df, name: held.setdefault(name, written(df, name)))
    docs = frame(spark, TEXTS)
    whole = ctw.score(docs, frame(spark, TRAIN), depth=3).orderBy("doc_id").collect()
    assert held["ctw_scored"].count() == len(TEXTS)
    monkeypatch.setattr(ctw, "COMMON", 0)
    held.clear()
    rare = ctw.score(docs, frame(spark, TRAIN), depth=3).orderBy("doc_id").collect()
    assert held["ctw_scored"].count() == len(TEXTS)
    assert [(r.n_tokens, r.n_known) for r in rare] == [(r.n_tokens, r.n_known) for r in whole]
    assert [r.base_score for r in rare] == pytest.approx([r.base_score for r in whole], rel=1e-12)


def test_edges(spark):
    docs = ctw.held_out_split(edge(spark))
    rows = ctw.score(docs, docs, depth=3).collect()
    assert len(rows) == docs.count()
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 5)} == {1}
    assert all(r.bits_per_byte is None for r in rows if r.n_bytes == 0)
    assert len([r for r in rows if r.doc_id == 9]) == 3
    none = ctw.held_out_split(empty(spark))
    assert ctw.score(none, none, depth=3).count() == 0
    assert ctw.score(docs, none, depth=3).filter("n_known > 0").count() == 0
