import numpy as np
import zlib
from tokenizers import Tokenizer

from kpiforge.llm import packing, queries
from kpiforge.llm.common import tokenizer_path
from tests.llm.fixtures import SF, EDGE, edge, empty

PATH = tokenizer_path("byte_bpe_50k.json")


def check_sequences(rows, max_len):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= max_len
    return len(seqs)


def test_ids_equal_tokenizers(spark):
    slow = Tokenizer.from_file(PATH)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["a <|endoftext|> b", "<|endoftext|>", " x\n\n  é 　 \x85 ñ\t\tq  ", "don't I'LL 12345 ½ ² ﬁ 漢字 😀", "", " ", "\n", "a" * 5000]
    got = packing.Encoder(PATH).encode(texts)
    for t, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == slow.encode(t, add_special_tokens=False).ids


def test_query_round_trip(spark):
    slow = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op2_pattern_packing"](spark, SF).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(docs)
    for d, pieces in by_doc.items():
        ids = slow.encode(docs[d], add_special_tokens=False).ids + [2]
        at = 0
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            assert r.length == 1024 or r.piece == 0
            at += r.length
        assert at == len(ids)
    total = sum(r.length for r in rows)
    assert check_sequences(rows, 1024) <= -(-total // 1024) + 2


def test_plan_uses_every_piece_once_and_is_tight():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.geometric(0.01, 20_000), 256)
    hist = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    plan = packing.solve(hist, 256)
    used = {}
    for pattern, n in plan.uses:
        assert sum(pattern) <= 256
        for v in pattern:
            used[v] = used.get(v, 0) + n
    assert used == hist
    assert plan.sequences <= 1.01 * lengths.sum() / 256 + 1


def test_patterns_are_all_exact_fills():
    got = {tuple(v for v in p if v) for p in packing.patterns(np.arange(1, 13), 12).tolist()}
    want = {(12,)} | {(a, 12 - a) for a in range(6, 12)} | {(a, b, 12 - a - b) for a in range(1, 13) for b in range(1, a + 1) if 1 <= 12 - a - b <= b}
    assert got == want


def test_edges_and_salts(spark):
    rows = packing.pack(edge(spark), PATH, max_len=64, per_salt=2, with_ids=True).collect()
    check_sequences(rows, 64)
    assert sum(r.length == 1 and r.doc_id in (2, 3) for r in rows) == 2      # only the end id
    assert {r.doc_id for r in rows} == {d for d, *_ in EDGE}
    assert all(len(r.ids) == r.length for r in rows)
    assert packing.pack(empty(spark), PATH).count() == 0


def test_query_and_stage_carry_the_tokens(spark):
    import corpus_pipeline

    slow = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: slow.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    for out in (queries.QUERIES["op2_pattern_packing"](spark, SF), corpus_pipeline.best_fit_packing(spark, docs, SF)):
        rows = out.collect()
        assert sum(r.length for r in rows) == sum(map(len, want.values()))
        for r in rows:
            assert r.ids == want[r.doc_id][r.start:r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())


def test_narrow_ids_come_back():
    import pyarrow as pa

    rows = [[0, 65535], [65536, 1, 2], [7]]
    raw = [np.array(r, "<u4").tobytes() for r in rows]
    ids, crc = packing.widen(pa.array([packing.narrow(r) for r in raw], pa.binary()), np.array([2, 3, 1]))
    assert ids.to_pylist() == rows and crc.to_pylist() == [zlib.crc32(r) for r in raw]
    assert [len(packing.narrow(r)) for r in raw] == [4, 12, 2]


def test_long_runs_of_one_character():
    """Texts that the fast pattern cannot split have the ids of tokenizers."""
    path = tokenizer_path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    for text in ("a" + " " * 1_000_000 + "b", "a" + "\n" * 1_000_000 + "b", "x" * 20_000):
        want = np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert packing.Encoder(path).encode([text]) == [want]


def test_an_encoder_goes_with_its_task():
    """Workers outlive tasks, and every task has an encoder: it is freed without the garbage collector."""
    import gc
    import weakref

    gc.collect()
    gc.disable()
    try:
        held = packing.Encoder(PATH)
        assert held.encode(["a b"])
        seen = weakref.ref(held)
        del held
        assert seen() is None
    finally:
        gc.enable()


def test_give_back_frees_what_refers_to_itself():
    import gc
    import weakref

    from kpiforge.llm import common

    class Held:
        pass

    gc.disable()
    try:
        held = Held()
        held.me, seen = held, weakref.ref(held)
        del held
        common.give_back()
        assert seen() is None
    finally:
        gc.enable()
