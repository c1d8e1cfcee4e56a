"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all benchmark items form one automaton whose
states are the classes of item substrings. Training words are streamed
through it; at each word the automaton knows the longest run of words
ending there that occurs in some item. Where that run reaches ``window``
words (or is a whole shorter item), the words of the run are *hit*.

Spark side: documents are read once, in a map without any shuffle. The
benchmark is not bounded by nature, so its words are cut into blocks of
at most ``block_words`` and one automaton is broadcast for each block;
with several blocks the hits of a document are merged by a grouping on
the document afterwards. The usual benchmark is one block.

Streaming touches only runs of words in which every neighbouring pair
also occurs in an item: outside of them the matched length is below two
and no window can end, so skipping them changes nothing. The pair test is
vectorised.

Documents of which a share of words is hit are contaminated. Out of the
others :func:`clean` cuts the hit spans of at least ``length`` words; what
is hit by shorter whole items only may be a common phrase and stays.

Nulls and empty texts have no words (and hit nothing); items without
words have no window; repeated items and rows are kept as given (items
count once per id); empty tables give empty results or no hits.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiforge.llm.common import slices, written

#: A-Z lower-cased, every byte that is no word byte a blank; bytes from 0x80 are word bytes.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class Automaton:
    """Generalised suffix automaton of word sequences.

    ``items13[state]``: items with the window that ends in the state;
    ``whole[state]``: (length, items) of the shorter items that end there;
    ``up_whole[state]``: nearest state, itself or above, with ``whole``."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = 13):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        seqs = []
        for item, ws in items:
            seq = [self.vocab.setdefault(w, len(self.vocab)) for w in ws]
            if seq:
                seqs.append((item, seq))
        for _, seq in seqs:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.items: dict[int, set[str]] = {}
        self.whole: dict[int, tuple[int, set[str]]] = {}
        pairs = set()
        for item, seq in seqs:
            pairs.update(zip(seq, seq[1:]))
            state = length = 0
            for c in seq:
                state, length = self.next[state][c], length + 1
                if length >= window:
                    self.items.setdefault(self._cut(state, window), set()).add(item)
            if len(seq) < window:
                at = self._cut(state, len(seq))
                self.whole.setdefault(at, (len(seq), set()))[1].add(item)
        order = sorted(range(len(self.len)), key=self.len.__getitem__)
        self.up_whole = [-1] * len(order)
        for s in order[1:]:
            self.up_whole[s] = s if s in self.whole else self.up_whole[self.link[s]]
        v = len(self.vocab)
        self.pairs = np.array(sorted(a * v + b for a, b in pairs), np.int64)
        self.shortest = min([min(len(s), window) for _, s in seqs], default=0)

    def _cut(self, state: int, length: int) -> int:
        """State of the last ``length`` words of a string in ``state``."""
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.len)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def runs(self, ids: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """Stretches [a, b) of one document that can hold a window."""
        if not self.shortest or not len(ids):
            return []
        ok = ids >= 0
        pair = np.zeros(len(ids), bool)     # word i and i + 1 are neighbours in an item
        at = np.flatnonzero(ok[:-1] & ok[1:] & (doc[:-1] == doc[1:]))
        if len(at) and len(self.pairs):
            code = ids[at] * len(self.vocab) + ids[at + 1]
            spot = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            pair[at[self.pairs[spot] == code]] = True
        first = ok & ~np.concatenate(([False], pair[:-1]))
        last = ok & ~pair
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        long = b - a >= self.shortest
        return list(zip(a[long].tolist(), b[long].tolist()))

    def stream(self, ids: list[int]):
        """(first, last, items) of each window that ends in a run of ids."""
        nxt, link, length, window = self.next, self.link, self.len, self.window
        state = n = 0
        for i, c in enumerate(ids):
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                n += 1
            else:
                n = 0
            if n >= window:
                yield i - window + 1, i, self.items.get(self._cut(state, window), ())
            w = self.up_whole[state]
            while w != -1:
                m, items = self.whole[w]
                if m <= n:
                    yield i - m + 1, i, items
                w = self.up_whole[link[w]]


def automata(benchmark: DataFrame, window: int, block_words: int):
    """One automaton for each block of items; only one block's rows are on
    the driver at a time."""
    block: list = []
    size = 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").dropDuplicates()
    for r in rows.toLocalIterator():
        ws = words((r["text"] or "").encode())
        if not ws:
            continue
        if block and size + len(ws) > block_words:
            yield Automaton(block, window)
            block, size = [], 0
        block.append((r["item_id"], ws))
        size += len(ws)
    yield Automaton(block, window)


def merge(spans: list[tuple[int, int]]) -> list[dict]:
    """Sorted, joined half-open spans."""
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"
CUT = FOUND + ", cut string"
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def without(text: str | None, spans: list[dict], length: int) -> str | None:
    """The text without those spans of ``length`` words or more, from their
    first word's start to their last word's end; None if there are none."""
    spans = [s for s in spans if s["end"] - s["start"] >= length]
    if not spans:
        return None
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    keep, pos = [], 0
    for s in spans:
        keep.append(raw[pos:at[s["start"]][0]])
        pos = at[s["end"] - 1][1]
    return b"".join([*keep, raw[pos:]]).decode()


def _find(automaton, key_fields, text: str = "text", cut: int | None = None):
    """Map function: for each document its word count, its hit word spans
    (merged, half open) and the items found, after the ``key_fields``;
    with ``cut`` also the text without spans of that many words (null
    where there are none)."""
    names = [*key_fields.names, "n_words", "spans", "items", *(["cut"] if cut else [])]
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        m = automaton.value
        get = m.vocab.get
        for piece in slices(batches, text, 1 << 20):
            bag: list = []
            lens = []
            for t in piece.column(piece.schema.get_field_index(text)).cast(pa.binary()).to_pylist():
                w = words(t) if t else []
                lens.append(len(w))
                bag += w
            ids = np.array([get(w, -1) for w in bag], np.int64)
            off = np.concatenate(([0], np.cumsum(lens)))
            doc = np.repeat(np.arange(len(lens)), lens)
            spans: list = [[] for _ in lens]
            items: list = [set() for _ in lens]
            for a, b in m.runs(ids, doc):
                d = int(doc[a])
                for i, j, which in m.stream(ids[a:b].tolist()):
                    spans[d].append((int(a + i - off[d]), int(a + j - off[d] + 1)))
                    items[d].update(which)
            spans = [merge(x) for x in spans]
            cols = [piece.column(piece.schema.get_field_index(n)) for n in key_fields.names]
            if cut:
                whole = piece.column(piece.schema.get_field_index(text))
                rest = [pa.array([without(whole[i].as_py(), x, cut) if x else None for i, x in enumerate(spans)], pa.string())]
            else:
                rest = []
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lens, pa.int64()), pa.array(spans, span_type), pa.array([sorted(x) for x in items], pa.list_(pa.string())), *rest], names=names)

    return run


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", window: int = 13, block_words: int = 1_000_000) -> DataFrame:
    """key, n_words, spans (hit words, merged and half open, as word
    numbers) and items (ids found, sorted) of each document."""
    held = [docs.sparkSession.sparkContext.broadcast(a) for a in automata(benchmark, window, block_words)]
    return _found(docs.select(key, "text"), held, key)


def _found(docs: DataFrame, held: list, key: str) -> DataFrame:
    key_fields = T.StructType([f for f in docs.schema.fields if f.name != "text"])
    schema = T.StructType([*key_fields.fields, *T._parse_datatype_string(FOUND).fields])
    if len(held) == 1:
        return docs.mapInArrow(_find(held[0], key_fields), schema)
    # Several blocks: the rows of one document meet by its key and text digest.
    docs = docs.withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    key_fields = T.StructType([f for f in docs.schema.fields if f.name != "text"])
    schema = T.StructType([*key_fields.fields, *T._parse_datatype_string(FOUND).fields])
    parts = [docs.mapInArrow(_find(b, key_fields), schema) for b in held]
    got = reduce(DataFrame.unionByName, parts).groupBy(key, "digest").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count("*") / len(held)).cast("int").alias("copies"))
    merged = F.aggregate(
        F.array_sort("spans"), F.array().cast("array<struct<start:long,end:long>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(x))))
    return (got.withColumn("spans", merged).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
            .select(key, "n_words", "spans", "items"))


def judged(found: DataFrame, coverage: float = 0.05, min_hit: int = 1) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated: at least
    ``min_hit`` words and the share ``coverage`` (to nine digits) of all
    words are hit. The share is compared in whole numbers."""
    share = Fraction(coverage).limit_denominator(10**9)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    enough = F.col("n_hit").cast("decimal(20)") * F.lit(share.denominator).cast("decimal(10)") >= F.col("n_words").cast("decimal(20)") * F.lit(share.numerator).cast("decimal(10)")
    return (found.withColumn("n_hit", n_hit)
            .withColumn("n_items", F.size("items").cast("long"))
            .withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256))
            .withColumn("contaminated", (F.col("n_hit") >= min_hit) & enough))


def cut_spans(docs: DataFrame, found: DataFrame, key: str = "doc_id", length: int = 1) -> DataFrame:
    """docs with the hit spans of at least ``length`` words cut out of
    ``text``. ``key`` must be unique in docs."""
    schema = docs.schema

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            for i, spans in enumerate(batch.column(batch.schema.get_field_index("__spans")).to_pylist()):
                cut = without(texts[i], spans or [], length)
                texts[i] = texts[i] if cut is None else cut
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(i) for i, n in enumerate(batch.schema.names) if n != "__spans"], names=schema.names)

    return docs.join(found.select(key, F.col("spans").alias("__spans")), key, "left").select(*schema.names, "__spans").mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.05, min_hit: int = 1, window: int = 13, length: int = 13, block_words: int = 1_000_000) -> DataFrame:
    """The rows of docs that are not contaminated; hit spans of ``length``
    words or more are cut out of their texts (``n_chars``, where there is
    one, is set anew for those rows). One map; with several blocks of items
    a join on id and text digest."""
    held = [docs.sparkSession.sparkContext.broadcast(a) for a in automata(benchmark, window, block_words)]
    names = docs.columns
    if len(held) == 1:
        own = docs.select(*[F.col(c).alias(f"__{c}") for c in names])
        found = own.mapInArrow(_find(held[0], own.schema, "__text", length), T.StructType([*own.schema.fields, *T._parse_datatype_string(CUT).fields]))
        new = {"text": F.coalesce("cut", "__text"), "n_chars": F.when(F.col("cut").isNull(), F.col("__n_chars")).otherwise(F.length("cut"))}
        return judged(found, coverage, min_hit).filter("NOT contaminated").select(*[new.get(c, F.col(f"__{c}")).cast(docs.schema[c].dataType).alias(c) for c in names])
    own = docs.withColumn("__key", F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")))))
    hit = judged(_found(own.select("__key", "text"), held, "__key"), coverage, min_hit).filter("n_hit > 0").dropDuplicates(["__key"])
    hit = written(hit.select("__key", "spans", "contaminated"), "decontam_hits")
    rest = own.join(hit.filter("contaminated"), "__key", "left_anti").select(*own.columns)
    out = cut_spans(rest.withColumn("__old", F.length("text")), hit.filter("NOT contaminated"), "__key", length)
    if "n_chars" in names:
        changed = F.length("text") != F.col("__old")
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*names)


def sql(window: int = 13, coverage: int = 20) -> str:
    """find() and judged() over ``documents`` and ``benchmark`` in DuckDB."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words} AS w FROM benchmark),
bl AS (SELECT item, w, least({window}, len(w)) AS l FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, l, list_slice(w, i, i + l - 1) AS win FROM (SELECT item, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM bl)),
dl AS (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l),
hits AS (SELECT r, i, bw.l, item FROM (SELECT r, i, l, list_slice(w, i, i + l - 1) AS win FROM dl) x JOIN bw ON x.l = bw.l AND x.win = bw.win),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hits) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {coverage} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
