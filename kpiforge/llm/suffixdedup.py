"""Repeated byte strings across documents by a depth-limited radix sort.

Suffixes are told apart by their first ``WINDOW`` bytes only, most
significant digit first; the groups that are still equal at that depth are
exactly the repeated windows. Removed is every byte covered by a window
that also starts in a document with a smaller id.

The passes, each on what the one before could not settle:

1. *Anchor digit.* The windows of a text fall into units: runs of
   neighbouring windows whose least k-gram (by hash, k = 24) is the same;
   about one unit for 14 bytes. Equal windows have equal anchors, so a
   unit whose anchor occurs in no other document is settled: nothing in
   it is repeated.
2. *Unit digit.* Units with equal anchor and equal content: all but the
   least document lose the whole unit. Where all units of an anchor are
   equal, that settles them.
3. *Window digit.* Only units whose anchor has several contents (the
   edges of shared passages) are cut into their windows, which are
   compared each.

Keys are fingerprints of 88 bits (units) and 104 bits (windows), whose
digits deal the rows to buckets; a bucket is sorted with numpy. A task
settles its own equal rows first and sends one row for each distinct key,
with the least document: a passage in a third of all documents is one row
a task, and no group is collected. Anchors with several contents inside a
task go straight to pass 3 and send one mark. Buckets grow with the input
over ``spark.sql.shuffle.partitions``.

Null texts are empty, texts below the window keep all bytes; null ids come
after all others, and rows with equal ids are one document, which never
removes from itself. Very long texts are worked on in parts that overlap
by a window. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import NULL_ID, byte_table, mix64, power_tables, slices, text_buffers, written

WINDOW = 50
K = 24
SPAN = WINDOW - K + 1           # k-grams of a window; at most so many windows in a unit
PART = 1 << 18           # numpy works in the processor's cache
_TABLE = byte_table(101), byte_table(202)
_MULT = 0xD1342543DE82EF95
_U = np.uint64


def _power(n: int) -> np.uint64:
    return _U(pow(_MULT, n, 1 << 64))


def _rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of all strings of K and of WINDOW bytes, by
    doubling: 2, 4, 8, 16, 32, then 24 = 16 + 8 and 50 = 32 + 16 + 2."""
    with np.errstate(over="ignore"):
        r = {1: _TABLE[0][data]}
        for n in (2, 4, 8, 16, 32):
            half = r[n // 2]
            r[n] = half[:-(n // 2)] * _power(n // 2) + half[n // 2:]
        gram = r[16][:-8] * _power(8) + r[8][16:]
        m = len(data) - WINDOW + 1
        window = r[32][:m] * _power(18) + r[16][32:32 + m] * _power(2) + r[2][48:48 + m]
    return gram, window


class Units:
    """The units of some texts: ``anchor`` (48 bits) and ``content`` (40
    bits) fingerprints, ``first`` window and ``count`` of windows, ``text``
    number; ``windows`` are the fingerprints of all windows by position."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        none = np.zeros(0, np.int64)
        self.data = data
        self.anchor = self.content = np.zeros(0, _U)
        self.first = self.count = self.text = none
        self.windows = np.zeros(0, _U)
        m = len(data) - WINDOW + 1
        if m <= 0:
            return
        gram, window = _rolling(data)
        v = mix64(gram)
        for step in (1, 2, 4, 8):
            v = np.minimum(v[:-step], v[step:])
        v = np.minimum(v[:m], v[SPAN - 16:SPAN - 16 + m])
        edge = np.zeros(m + 1, np.int64)
        ends = off[1:]
        np.add.at(edge, np.clip(np.maximum(ends - WINDOW + 1, off[:-1]), 0, m), 1)
        np.add.at(edge, np.clip(ends, 0, m), -1)
        s = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
        if not len(s):
            return
        v = v[s]
        run = np.concatenate(([True], (v[1:] != v[:-1]) | (s[1:] != s[:-1] + 1)))
        head = np.flatnonzero(run)
        place = np.arange(len(s)) - np.repeat(head, np.diff(np.concatenate((head, [len(s)]))))
        u = np.flatnonzero(place % SPAN == 0)
        self.windows = mix64(window)
        self.first = s[u]
        self.count = np.diff(np.concatenate((u, [len(s)])))
        self.text = np.searchsorted(off, self.first, side="right") - 1
        with np.errstate(over="ignore"):
            self.anchor = mix64(v[u] + _U(1)) >> _U(16)
            a, b = self.windows[self.first], self.windows[self.first + self.count - 1]
            self.content = mix64(a * _U(0x9E3779B97F4A7C15) + (b ^ _U(0x5555)) * _U(0xD6E8FEB86659FD93) + self.count.astype(_U)) >> _U(24)

    def keys(self) -> np.ndarray:
        return unit_key(self.anchor, self.content)

    def window_at(self, units: np.ndarray) -> np.ndarray:
        """Positions of all windows of the given units."""
        n = self.count[units]
        return np.repeat(self.first[units] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())

    def second(self, at: np.ndarray) -> np.ndarray:
        """A further 40 bits of the windows at the given positions."""
        up, down = power_tables(len(self.data))
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, _U), np.cumsum(_TABLE[1][self.data] * up, dtype=_U)))
            return mix64((total[at + WINDOW] - total[at]) * down[at]) >> _U(24)


def unit_key(anchor: np.ndarray, content: np.ndarray) -> np.ndarray:
    """One number for a unit inside its document; the lowest bit is free."""
    with np.errstate(over="ignore"):
        return mix64(anchor * _U(0x9E3779B97F4A7C15) + content * _U(0xC2B2AE3D27D4EB4F)) & ~_U(1)


def parts(column: pa.Array, ids: np.ndarray):
    """(data, offsets, document ids, text numbers, start of each part in
    its text): texts by about PART bytes; longer ones are cut into parts
    that overlap by WINDOW - 1 bytes, so each window is in exactly one."""
    data, off = text_buffers(column)
    n = len(off) - 1
    i = 0
    while i < n:
        if off[i + 1] - off[i] > PART:
            for a in range(off[i], off[i + 1] - WINDOW + 1, PART):
                b = min(a + PART + WINDOW - 1, off[i + 1])
                yield data[a:b], np.array([0, b - a]), ids[i:i + 1], np.array([i]), np.array([a - off[i]])
            i += 1
            continue
        j = i + 1
        while j < n and off[j + 1] - off[i] <= PART:
            j += 1
        yield data[off[i]:off[j]], off[i:j + 1] - off[i], ids[i:j], np.arange(i, j), np.zeros(j - i, np.int64)
        i = j


def _planes(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of 64-bit numbers as byte planes (the low ``size`` bytes);
    planes that are all zero compress to nothing."""
    return b"".join(np.ascontiguousarray(c).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes() for c, size in columns)


def _unplanes(payload: bytes, *sizes: int) -> list[np.ndarray]:
    raw = np.frombuffer(payload, np.uint8).reshape(sum(sizes), -1)
    out, at = [], 0
    for size in sizes:
        wide = np.zeros((raw.shape[1], 8), np.uint8)
        wide[:, :size] = raw[at:at + size].T
        out.append(wide.view("<u8").ravel())
        at += size
    return out


def _runs(*columns: np.ndarray) -> np.ndarray:
    """True at the first row of each run of equal rows."""
    if not len(columns[0]):
        return np.zeros(0, bool)
    new = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.concatenate(([True], new))


def _spread(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The value at each run's first row, for all rows of the run."""
    return values[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]


def _group_any(flag: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether any row of the run has the flag, for all its rows."""
    run = np.cumsum(first) - 1
    return (np.bincount(run, flag) > 0)[run]


REMOVE, COMPARE = _U(0), _U(1)      # lowest bit of a unit key in a verdict


def settle_here(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray):
    """Pass 1 and 2 inside a task. Returns the verdicts (doc, key) known
    here, and the rows to send (anchor, content, doc, mark)."""
    order = np.lexsort((doc, content, anchor))
    anchor, content, doc = anchor[order], content[order], doc[order]
    unit = _runs(anchor, content)
    least = _spread(doc, unit)
    own = (doc == least) & _runs(anchor, content, doc)
    gone = doc > least
    group = _runs(anchor)
    several = _group_any(unit & ~group, group)
    key = unit_key(anchor, content)
    out = [(doc[gone], key[gone] | REMOVE), (doc[own & several], key[own & several] | COMPARE)]
    send = own & ~several
    mark = group & several
    rows = [np.concatenate((c[send], c[mark])) for c in (anchor, content, doc)]
    flag = np.concatenate((np.zeros(send.sum(), _U), np.ones(mark.sum(), _U)))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]), (*rows, flag)


def settle_bucket(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pass 1 and 2 between tasks: verdicts (doc, key) of the sent rows."""
    order = np.lexsort((doc, content, mark, anchor))
    anchor, content, doc, mark = anchor[order], content[order], doc[order], mark[order]
    group = _runs(anchor)
    unit = _runs(anchor, mark, content)
    mixed = _group_any((mark > 0) | (unit & ~group), group)
    gone = (doc > _spread(doc, unit)) & (mark == 0)
    rest = ~gone & mixed & (mark == 0)
    key = unit_key(anchor, content)
    return np.concatenate((doc[gone], doc[rest])), np.concatenate((key[gone] | REMOVE, key[rest] | COMPARE))


def _dealt(kind: int, order_by: np.ndarray, bits: int, buckets: int, columns: list[tuple[np.ndarray, int]]):
    """Rows sorted by ``order_by``, as (bucket, kind, payload) by its
    leading bits."""
    bucket = ((order_by >> _U(bits - 32)) * _U(buckets)) >> _U(32)
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)):
        yield int(b), kind, _planes(*((c[cut[b]:cut[b + 1]], size) for c, size in columns))


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "payload"])


DEALT = "bucket int, kind int, payload binary"
VERDICT, UNITS, WINDOWS = 0, 1, 2


def _verdicts(doc: np.ndarray, key: np.ndarray, buckets: int) -> list:
    """Settled rows need no company: any bucket will do."""
    n = len(doc)
    return [(int(i % buckets), VERDICT, _planes((doc[a:a + 65536], 8), (key[a:a + 65536], 8))) for i, a in enumerate(range(0, n, 65536))]


def _pairs(doc: np.ndarray, key: np.ndarray):
    for a in range(0, len(doc), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(doc[a:a + (1 << 18)].astype(np.int64)), pa.array(key[a:a + (1 << 18)].view(np.int64))], names=["doc", "key"])


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def unit_verdicts(docs: DataFrame, buckets: int, flush: int = 1_500_000) -> DataFrame:
    """(doc, key): units to remove or to compare by windows."""
    def local(batches):
        held: list = []
        size = 0

        def settle():
            doc, key, (a, c, d, m) = settle_here(*(np.concatenate(x) for x in zip(*held)))
            order = np.argsort(a, kind="stable")
            rows = _verdicts(doc.astype(_U), key, buckets)
            rows += _dealt(UNITS, a[order], 48, buckets, [(a[order], 6), (c[order], 5), (d[order].astype(_U), 8), (m[order], 1)])
            held.clear()
            for i in range(0, len(rows), 64):
                yield _batch(rows[i:i + 64])

        for piece in slices(batches, "text", 2 << 20):
            for data, off, ids, _, _ in parts(piece.column(1), _ids(piece.column(0))):
                u = Units(data, off)
                held.append((u.anchor, u.content, ids[u.text]))
                size += len(u.anchor)
                if size >= flush:
                    yield from settle()
                    size = 0
        if size:
            yield from settle()

    def between(batches):
        units: list = []
        for b in batches:
            for kind, payload in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if kind == VERDICT:
                    yield from _pairs(*_unplanes(payload, 8, 8))
                else:
                    units.append(_unplanes(payload, 6, 5, 8, 1))
        if units:
            yield from _pairs(*settle_bucket(*(np.concatenate(x) for x in zip(*units))))

    return docs.mapInArrow(local, DEALT).repartition("bucket").mapInArrow(between, "doc long, key long")


def _marked(piece: pa.RecordBatch, bits: tuple[np.uint64, ...]):
    """(units, chosen units for each of ``bits``, document ids, text
    numbers, starts) of the parts of texts that have unit verdicts of these
    kinds. Columns: doc, text, keys."""
    keys = piece.column(2)
    counts = keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = keys.flatten().to_numpy().view(_U)
    row = np.repeat(np.arange(piece.num_rows), counts)
    mine = np.isin(flat & _U(1), np.array(bits, _U))
    flat, row = flat[mine], row[mine]
    order = np.lexsort((flat, row))
    flat, row = flat[order], row[order]
    rows = np.unique(row)
    if not len(rows):
        return
    has = np.zeros(piece.num_rows, bool)
    has[rows] = True
    first = np.searchsorted(row, np.arange(piece.num_rows + 1))
    for data, off, ids, text, start in parts(piece.column(1).filter(pa.array(has)), _ids(piece.column(0))[rows]):
        u = Units(data, off)
        key = u.keys()
        number = rows[text]
        cut = np.searchsorted(u.text, np.arange(len(text) + 1))
        chosen = np.zeros((len(bits), len(key)), bool)
        for t in range(len(text)):
            wanted = flat[first[number[t]]:first[number[t] + 1]]
            part = key[cut[t]:cut[t + 1]]
            for k, bit in enumerate(bits):
                at = np.minimum(np.searchsorted(wanted, part | bit), len(wanted) - 1)
                chosen[k, cut[t]:cut[t + 1]] = wanted[at] == (part | bit)
        yield u, off, [np.flatnonzero(c) for c in chosen], ids, number, start


def repeated_windows(marked: DataFrame, buckets: int, flush: int = 2_000_000) -> DataFrame:
    """(doc, key): windows (64-bit fingerprint) of units to compare that a
    smaller document has too. ``marked``: doc, text, keys."""
    def local(batches):
        held: list = []
        size = 0

        def settle():
            w, x, d = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((d, x, w))
            w, x, d = w[order], x[order], d[order]
            same = _runs(w, x)
            one = _runs(w, x, d)
            least = _spread(d, same)
            gone, send = one & (d > least), one & (d == least)
            rows = _verdicts(d[gone].astype(_U), w[gone], buckets)
            rows += _dealt(WINDOWS, w[send], 64, buckets, [(w[send], 8), (x[send], 5), (d[send].astype(_U), 8)])
            for i in range(0, len(rows), 64):
                yield _batch(rows[i:i + 64])

        for piece in slices(batches, "text", 2 << 20):
            for u, _, (chosen,), ids, _, _ in _marked(piece, (COMPARE,)):
                if len(chosen):
                    at = u.window_at(chosen)
                    held.append((u.windows[at], u.second(at), np.repeat(ids[u.text[chosen]], u.count[chosen])))
                    size += len(at)
                if size >= flush:
                    yield from settle()
                    size = 0
        if size:
            yield from settle()

    def between(batches):
        rows: list = []
        for b in batches:
            for kind, payload in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if kind == VERDICT:
                    yield from _pairs(*_unplanes(payload, 8, 8))
                else:
                    rows.append(_unplanes(payload, 8, 5, 8))
        if rows:
            w, x, d = (np.concatenate(c) for c in zip(*rows))
            order = np.lexsort((d, x, w))
            w, x, d = w[order], x[order], d[order]
            gone = d > _spread(d, _runs(w, x))
            yield from _pairs(d[gone], w[gone])

    return marked.mapInArrow(local, DEALT).repartition("bucket").mapInArrow(between, "doc long, key long")


OUT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _cut(batches):
    """doc, text, keys, windows, doc_id -> OUT."""
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for piece in slices(batches, "text", 2 << 20):
        data, off = text_buffers(piece.column(1))
        edge = np.zeros(len(data) + 1, np.int64)
        touched = np.zeros(piece.num_rows, bool)

        def cover(at, start, text):
            np.add.at(edge, off[text] + start, 1)
            np.add.at(edge, off[text] + start + at, -1)
            touched[text] = True

        windows = [np.sort(np.array(w or (), np.int64).view(_U)) for w in piece.column(3).to_pylist()]
        for u, poff, (gone_units, chosen), _, number, start in _marked(piece, (REMOVE, COMPARE)):
            t = u.text[gone_units]
            cover(u.count[gone_units] + WINDOW - 1, u.first[gone_units] - poff[t] + start[t], number[t])
            at = u.window_at(chosen)
            t = np.repeat(u.text[chosen], u.count[chosen])
            cut = np.searchsorted(t, np.arange(len(number) + 1))
            for k in range(len(number)):
                w = windows[number[k]]
                if len(w) and cut[k + 1] > cut[k]:
                    here = at[cut[k]:cut[k + 1]]
                    mine = u.windows[here]
                    here = here[w[np.minimum(np.searchsorted(w, mine), len(w) - 1)] == mine]
                    if len(here):
                        cover(WINDOW, here - poff[k] + start[k], np.full(len(here), number[k]))
        spans: list = [[] for _ in range(piece.num_rows)]
        kept = []
        gone = np.cumsum(edge[:-1]) > 0
        for i in range(piece.num_rows):
            text = data[off[i]:off[i + 1]]
            if touched[i]:
                g = np.concatenate(([False], gone[off[i]:off[i + 1]], [False]))
                turn = np.flatnonzero(g[1:] != g[:-1])
                spans[i] = [{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)]
                text = text[~g[1:-1]]
            kept.append(text.tobytes())
        yield pa.RecordBatch.from_arrays([piece.column(4), pa.array(np.diff(off)), pa.array(spans, span_type), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed bytes, maximal, half open) and kept
    (the remaining bytes; cuts may fall inside a character)."""
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), "text")
    verdicts = written(unit_verdicts(docs, buckets), "suffix_units").groupBy("doc").agg(F.collect_list("key").alias("keys"))
    marked = docs.join(verdicts, "doc", "left").select("doc", "text", "keys")
    windows = repeated_windows(marked.filter(F.exists("keys", lambda k: k.bitwiseAND(F.lit(1)) == 1)), buckets).groupBy("doc").agg(F.collect_list("key").alias("windows"))
    both = marked.join(windows, "doc", "left").select("doc", "text", "keys", "windows", F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"))
    return both.mapInArrow(_cut, OUT)
