"""Near-duplicate documents by ProbMinHash, banding and verification.

A text is the weighted set of its five-word shingles (A-Z lower-cased,
weight = how often it occurs). Every shingle is a Poisson process whose
rate is its weight and whose arrivals, drawn from the shingle's hash, fall
on random registers; a register keeps the shingle of its first arrival.
Two texts agree in a register with the probability Jaccard similarity of
their weights. Arrivals are made round by round for all shingles of many
texts at once, and a process ends when its time passes the text's latest
register (early termination).

1. One map over the texts gives signature, band keys, shingles and digest;
   the rows are written once.
2. Texts with equal words are one node from here on (one group-by on the
   digest), so groups of exact copies cost one row.
3. Nodes that share a band key are candidates. No pairs within a bucket
   are listed: each node is first held against the best-connected node of
   its buckets (a pair a node), and the links found are contracted to
   components. Only buckets that still span several components are left.
   Their nodes outside the largest component meet the others through an
   exact prefix filter (rarest shingles first, with a bound on what can
   still be shared), which loses no pair of the similarity but joins on
   rare shingles instead of on the bucket. Buckets are never cut.
4. Every candidate pair is verified: the exact probability Jaccard of the
   weighted shingles must reach ``similarity``.
5. Linked nodes form classes by alternating large and small stars, in
   tables; nothing of it passes through the driver.

Texts of under five words have one shingle, all their words; texts without
words (null, empty) are a class of their own kind: they equal each other.
Empty tables give empty results; repeated rows are copies. Null ids take
part; a class of null ids only has a null class id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import NULL_ID, mix64, slices, text_buffers, word_hashes, written

SIZE = 5
SIMILARITY = 0.8
BANDS, ROWS = 64, 8         # a pair of similarity 0.8 shares no band with probability 0.83^64 = 8e-6

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(column: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, weight) of all distinct shingles, sorted,
    and the number of words of each text."""
    data, off = text_buffers(column)
    n = len(off) - 1
    data = _LOWER[data]
    h, doc = word_hashes(data, off, ~_SPACE[data])
    n_words = np.bincount(doc, minlength=n)
    out_doc, out_hash = [], []
    with np.errstate(over="ignore"):
        if len(h) >= size:
            win = h[:len(h) - size + 1].copy()
            for j in range(1, size):
                win = win * np.uint64(0xD6E8FEB86659FD93) + h[j:len(h) - size + 1 + j]
            inside = doc[:len(win)] == doc[size - 1:]
            out_doc.append(doc[:len(win)][inside])
            out_hash.append(mix64(win[inside]))
        short = np.flatnonzero((n_words > 0) & (n_words < size))
        if len(short):
            first = np.concatenate(([0], np.cumsum(n_words)))[short]
            value = np.full(len(short), np.uint64(77))
            for j in range(size - 1):
                more = n_words[short] > j
                value[more] = value[more] * np.uint64(0xD6E8FEB86659FD93) + h[first[more] + j]
            out_doc.append(short)
            out_hash.append(mix64(value))
    if not out_doc:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0), n_words
    doc, key = np.concatenate(out_doc), np.concatenate(out_hash)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    head = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))))
    weight = np.diff(np.concatenate((head, [len(key)])))
    return doc[head], key[head], weight.astype(np.float64), n_words


def batch_shingles(batch: pa.RecordBatch, size: int):
    """shingles() of a batch's text column, worked on by half a megabyte."""
    doc, key, weight, words, at = [], [], [], [], 0
    for part in slices([batch], "text", 1 << 19):
        d, k, w, n = shingles(part.column(1), size)
        doc.append(d + at)
        key.append(k)
        weight.append(w)
        words.append(n)
        at += part.num_rows
    return np.concatenate(doc), np.concatenate(key), np.concatenate(weight), np.concatenate(words)


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """[n, k] registers: the hash of the shingle that arrived first (0: no
    shingles)."""
    out = np.zeros((n, k), np.uint64)
    rows = np.arange(n)                     # texts still in work, by their place in first / who
    first, who = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    time = np.zeros(len(key))
    step = 0
    while len(key):
        step += 1
        with np.errstate(over="ignore"):
            r = mix64(key + np.uint64(step) * np.uint64(0x9E3779B97F4A7C15))
            register = (mix64(r ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(k)).astype(np.int64)
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        cell = doc * k + register
        np.minimum.at(first, cell, time)
        won = first[cell] == time
        who[cell[won]] = key[won]
        if step > 8 and step % 8:
            continue
        alive = time < first.reshape(-1, k).max(1)[doc]
        doc, key, weight, time = doc[alive], key[alive], weight[alive], time[alive]
        if step % 32 == 0:                  # finished texts leave the tables
            out[rows] = who.reshape(-1, k)
            left, doc = np.unique(doc, return_inverse=True)
            rows = rows[left]
            first, who = first.reshape(-1, k)[left].ravel(), who.reshape(-1, k)[left].ravel()
    out[rows] = who.reshape(-1, k)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[n, bands] 64-bit keys, different for different bands."""
    with np.errstate(over="ignore"):
        out = np.empty((len(sig), bands), np.uint64)
        for b in range(bands):
            v = np.full(len(sig), np.uint64(b + 1))
            for r in range(rows):
                v = mix64(v * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
            out[:, b] = v
    return out


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard of two weighted sets (sorted distinct keys)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = b[at] == a
    va = np.where(both, wb[at], 0.0)
    only_b = wb.sum() - va.sum()
    ratio = va[both] / wa[both]
    if not len(ratio):
        return 0.0
    total = 0.0
    for r in np.unique(ratio):
        total += wa[both][ratio == r].sum() / (np.maximum(wa, va / r).sum() + only_b / r)
    return float(total)


SIGNED = "row long, doc_id long, raw binary, digest binary, bands array<long>, keys binary, weights binary"


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SIZE) -> DataFrame:
    """Signature rows of all documents. ``keys`` and ``weights`` are the
    shingles (the high 32 bits of their hashes, sorted; weights as float32,
    empty where all are 1). Write it before use."""
    names = [x.split()[0] for x in SIGNED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for piece in slices(batches, "text", 2 << 20):
            n = piece.num_rows
            doc, key, weight, n_words = batch_shingles(piece, size)
            keys = band_keys(signatures(doc, key, weight, n, bands * rows), bands, rows).view(np.int64)
            high = (key >> np.uint64(32)).astype("<u4")
            off = np.searchsorted(doc, np.arange(n + 1))
            out = []
            for i, (d, t) in enumerate(zip(piece.column(0).to_pylist(), piece.column(1).cast(pa.binary()).to_pylist())):
                a, b = off[i], off[i + 1]
                digest = hashlib.md5(b" ".join((t or b"").lower().split()) if n_words[i] else b"").digest()
                w = weight[a:b]
                plain = bool((w == 1).all())
                out.append((row + i + 1, d, hashlib.md5(t or b"").digest(), digest, keys[i] if n_words[i] else None, high[a:b].tobytes(), b"" if plain else w.astype("<f4").tobytes()))
            row += n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SIGNED)


def cut(batches, rows: int):
    """Batches of at most ``rows`` rows, none empty."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose similarity reaches ``least``. ``sets``: row,
    keys, weights."""
    def side(name):
        return sets.select(F.col("row").alias(name), F.col("keys").alias(f"k{name}"), F.col("weights").alias(f"w{name}"))

    def run(batches):
        def load(k, w):
            k = np.frombuffer(k, "<u4")
            return k, np.frombuffer(w, "<f4").astype(np.float64) if w else np.ones(len(k))

        for batch in cut(batches, 1024):
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("ka", "wa", "kb", "wb")]
            ok = [similarity(*load(ka, wa), *load(kb, wb)) >= least - 1e-9 for ka, wa, kb, wb in zip(*cols)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in "ab"], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node linked to each node of ``edges``
    (a, b), by alternating large-star and small-star steps."""
    cur = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    state = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = written(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "links")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                cur.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        state = now


def roots(parents: DataFrame) -> DataFrame:
    """(row, root) of a forest given as (row, parent), by pointer jumping."""
    cur = written(parents.select("row", F.col("parent").alias("root")), "pmh_roots")
    while True:
        up = cur.select(F.col("row").alias("r"), F.col("root").alias("next"))
        cur = written(cur.join(up, cur["root"] == up["r"], "left").select("row", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "pmh_roots")
        if cur.filter("moved").isEmpty():
            return cur.select("row", "root")
        cur = cur.select("row", "root")


FILTER_BITS = 1 << 26       # 8 MB; fuller filters only let more rows through


def only(df: DataFrame, rows: DataFrame) -> DataFrame:
    """df without most of the rows whose ``row`` is not in ``rows``, in one
    map: a Bloom filter of fixed size (FILTER_BITS, two bits a row) is
    built by Spark and broadcast. What passes must still be joined."""
    def bits(i):
        return F.pmod(F.xxhash64("row", F.lit(i)), F.lit(FILTER_BITS))

    words = (rows.select(F.explode(F.array(bits(0), bits(1))).alias("b"))
             .groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toArrow())
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[words["w"].to_numpy()] = words["v"].to_numpy().view(np.uint64)
    held = df.sparkSession.sparkContext.broadcast(table)
    names = df.columns

    def run(batches):
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            for c in ("__b0", "__b1"):
                at = b.column(b.schema.get_field_index(c)).to_numpy()
                ok &= (held.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            if ok.any():
                yield b.select(names).filter(pa.array(ok))

    return df.withColumn("__b0", bits(0)).withColumn("__b1", bits(1)).mapInArrow(run, df.schema)


def prefixes(rows: DataFrame, least: float) -> DataFrame:
    """row, token, i (its place, from 1), n (tokens), w (their weight) of
    the tokens that can be the first one that a set shares with a partner.
    ``rows``: row, tokens (rarest first, in one order for all), weights.

    If two sets share the masses P and Q, their probability Jaccard is at
    most 1 / (1/P + 1/Q - 1) (every term of its sum is at most
    1 / (1/p + (1 - Q)/q), which is concave and homogeneous). Weights are
    counts, so tokens that are not shared have at least weight 1 each:
    with the first shared token at place i of n, P <= 1 - (i - 1) / w."""
    w = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    some = rows.select("row", F.size("tokens").alias("n"), w.alias("w"), "tokens")
    first = F.slice("tokens", F.lit(1), (F.floor(F.lit(1 - least) * F.col("w") + 1e-6) + 1).cast("int"))
    return some.select("row", "n", "w", F.posexplode(first).alias("i", "token")).select("row", "token", (F.col("i") + 1).alias("i"), "n", "w")


def may_reach(least: float) -> str:
    """Condition on two prefix rows (x, y) with a common token: if it is the
    first common one, the sets can still reach ``least``. At most m tokens
    are shared then."""
    m = "least(nx - ix + 1, ny - iy + 1)"
    p, q = f"(1 - (nx - {m}) / wx)", f"(1 - (ny - {m}) / wy)"
    return f"({p} > 0 AND {q} > 0 AND {p} * {q} >= {least - 1e-9} * ({p} + {q} - {p} * {q}))"


def _rare_first(sets: DataFrame) -> DataFrame:
    """row, tokens (by how many of the sets have them, then value), weights."""
    def explode(batches):
        for b in cut(batches, 256):
            each = [np.frombuffer(k, "<u4").astype(np.int64) for k in b.column(1).to_pylist()]
            weight = [np.frombuffer(w, "<f4").astype(np.float64) if w else np.ones(len(k)) for k, w in zip(each, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), [len(k) for k in each])), pa.array(np.concatenate(each)), pa.array(np.concatenate(weight))], names=["row", "token", "weight"])

    each = written(sets.select("row", "keys", "weights").mapInArrow(explode, "row long, token long, weight double"), "pmh_tokens")
    df = each.groupBy("token").agg(F.count("*").alias("df"))
    return (each.join(df, "token").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("df", "token", "weight"))).alias("t"))
            .select("row", F.col("t.token").alias("tokens"), F.col("t.weight").alias("weights")))


def classes(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SIZE) -> DataFrame:
    """One row for each document: doc_id, class_id (least id of its class),
    copy_of (least id among texts with equal words), raw (md5 of the text),
    first (this row stands for its class: its least id, then first row)."""
    base = written(signed(docs, bands, rows, size), "pmh_signed")
    texts = written(base.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("copy_of")), "pmh_texts")
    nodes = base.select("row", "bands").join(texts.select("node"), base["row"] == texts["node"], "left_semi")
    # One exchange serves the count and the join.
    buckets = nodes.select("row", F.explode("bands").alias("band")).repartition("band")
    full = buckets.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(buckets.join(full, "band"), "pmh_members")
    degree = members.groupBy("row").agg(F.sum("n").alias("degree"))
    pivot = (members.join(degree, "row").groupBy("band").agg(F.max(F.struct("degree", (-F.col("row")).alias("r"))).alias("p"))
             .select("band", (-F.col("p.r")).alias("pivot")))
    shared = members.join(pivot, "band").filter("row <> pivot").groupBy("row", "pivot").agg(F.count("*").alias("m"))
    # The pivot met in most bands (the least of equals). A pivot has the greater (degree, -row), so these links are a forest.
    best = shared.groupBy("row").agg(F.max(F.struct("m", (-F.col("pivot")).alias("p"))).alias("x")).select(F.col("row").alias("a"), (-F.col("x.p")).alias("b"))
    tried = written(best, "pmh_tried")
    # Only candidates' shingles take part from here on.
    asked = members.select("row").distinct()
    sets = written(only(base.select("row", "keys", "weights"), asked).join(asked, "row", "left_semi"), "pmh_sets")
    links = written(verified(tried, sets, least), "pmh_links")
    root = roots(links.select(F.col("a").alias("row"), F.col("b").alias("parent")))
    comp = members.join(root, "row", "left").select("row", "band", F.coalesce("root", "row").alias("component"))
    # The rest: buckets that span several components; their largest one is not asked again within itself.
    split = comp.groupBy("band", "component").agg(F.count("*").alias("n"))
    mixed = (split.groupBy("band").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("top"))
             .filter("parts > 1").select("band", F.col("top.component").alias("top")))
    open_ = comp.join(mixed, "band")
    each = written(open_.groupBy("row").agg(F.first("component").alias("component"), F.max(F.col("component") != F.col("top")).alias("outer")), "pmh_open_rows")
    keys = written(prefixes(_rare_first(sets.join(each.select("row"), "row", "left_semi")), least).join(each, "row"), "pmh_prefixes")

    def end(df, e):
        return df.select("token", F.col("row").alias(e), F.col("component").alias(f"c{e}"), *[F.col(c).alias(f"{c}{e}") for c in ("i", "n", "w")])

    pairs = (end(keys.filter("outer"), "x").join(end(keys, "y"), "token").filter(f"cx <> cy AND {may_reach(least)}")
             .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    done = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    more = written(verified(pairs.join(done, ["a", "b"], "left_anti"), sets, least), "pmh_links")
    node_class = texts.join(root, texts["node"] == root["row"], "left").select("digest", "copy_of", F.coalesce("root", "node").alias("component"))
    if not more.isEmpty():
        # Links between trees: components of their roots.
        own = each.select("row", "component")
        between = more.join(own.select(F.col("row").alias("a"), F.col("component").alias("ca")), "a").join(own.select(F.col("row").alias("b"), F.col("component").alias("cb")), "b")
        joined = components(between.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).withColumnRenamed("component", "to")
        node_class = node_class.join(joined, node_class["component"] == joined["node"], "left").select("digest", "copy_of", F.coalesce("to", "component").alias("component"))
    ids = node_class.groupBy("component").agg(F.min("copy_of").alias("class_id"))
    node_class = node_class.join(ids, "component").select("digest", "copy_of", "class_id", "component")
    out = base.select("row", "doc_id", "raw", "digest").join(node_class, "digest")
    head = out.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("h")).select("component", F.col("h.row").alias("head"))
    return out.join(head, "component").select("doc_id", "class_id", "copy_of", "raw", (F.col("row") == F.col("head")).alias("first"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class: the least doc_id, and one row
    of rows that repeat it."""
    first = classes(docs, **options).filter("first").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__id"), "raw")
    own = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("raw__", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    # Both keys are the join's, so dropping repeated rows needs no other shuffle.
    return own.join(first.withColumnRenamed("raw", "raw__"), ["__id", "raw__"], "left_semi").dropDuplicates(["__id", "raw__"]).select(*docs.columns)
