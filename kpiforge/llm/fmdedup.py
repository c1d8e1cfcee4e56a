"""Repeated word passages across documents by FM-indexes.

Removed is every word covered by a window of ``WINDOW`` words whose word
sequence also starts in a document with a smaller id.

Documents are streamed against FM-indexes of shards. Shards are made by
content, so that a passage only has to meet one of them: the windows of a
text fall into units, runs of neighbouring windows with the same anchor
(the least of their K-grams by hash), and all units of an anchor belong to
one shard. A unit's segment is the words of its windows, at most
2 * WINDOW - K. The steps:

1. *Frequent K-grams.* Tasks report the K-grams that make up more than a
   small share of their words; those with at least a 2^-17 share of all
   words (so at most 2^17 of them) become anchors only where a window has
   nothing else. A line that stands in a third of all documents thus
   anchors few different segments, and shards stay even.
2. *Shared anchors.* Units whose anchor is in one document only are
   settled. A task sends an anchor once, however often it has it.
3. *Shards.* Segments of shared anchors go to their anchor's partition,
   equal ones once a task, with the least document that has them; others
   of the task match that copy in full. A partition is cut into shards of
   about ``SHARD`` words at borders between anchors. The FM-index of a
   shard is a wavelet matrix over the Burrows-Wheeler transform of its
   distinct segments (packed bits and rank counts), with the border
   lengths between neighbouring suffixes and the least document below
   each row. All segments are streamed through it together, each from its
   last word to its first: a backward-search step prepends the word; while
   the interval holds no smaller document, the match is shortened at its
   end to the enclosing interval of the suffix tree. That gives the
   matching statistic of every word against smaller documents; a window
   is repeated where it reaches WINDOW.
4. *Cut.* The repeated windows of each unit come back as one number a
   unit; the words they cover go.

Words are compared by 48-bit fingerprints, so two windows count as equal
when 50 fingerprints are. Null texts have no words; texts below the window
keep all; null ids come after all others, and rows with equal ids are one
document, which never removes from itself. Words and texts may be of any
length. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import NULL_ID, mix64, slices, text_buffers, word_hashes, written

WINDOW = 50
K = 12
SPAN = WINDOW - K + 1           # K-grams of a window; at most so many windows in a unit
SHARD = 400_000                 # words of an index, about
SHARE = 17                      # frequent: at least a 2^-SHARE share of all words
_MULT = 0xD1342543DE82EF95
_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


# ---- units of texts ----------------------------------------------------------------

def words(data: np.ndarray, off: np.ndarray, step: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of each word, and the number of its text, worked out in
    pieces of about ``step`` bytes that end at white space or a text's end."""
    out, text = [], []
    blank = _BLANK[data]
    a = 0
    while a < len(data):
        b = min(a + step, len(data))
        if b < len(data):
            after = np.flatnonzero(blank[b:b + step])
            b = b + int(after[0]) if len(after) else len(data)
        inner = off[(off > a) & (off < b)] - a
        h, t = word_hashes(data[a:b], np.concatenate(([0], inner, [b - a])), ~blank[a:b])
        # Empty texts share an offset, so numbers come from places.
        number = np.searchsorted(off, np.concatenate(([a], inner + a)), side="right") - 1
        out.append(h >> _U(16))
        text.append(number[t] if len(t) else t)
        a = b
    none = np.zeros(0, np.int64)
    return (np.concatenate(out), np.concatenate(text)) if out else (none.astype(_U), none)


def _power(n: int) -> np.uint64:
    return _U(pow(_MULT, n, 1 << 64))


def _rolling(h: np.ndarray) -> dict[int, np.ndarray]:
    """Polynomial hashes of all runs of K and WINDOW words, by doubling."""
    with np.errstate(over="ignore"):
        r = {1: mix64(h)}
        for n in (2, 4, 8, 16, 32):
            half = r[n // 2]
            r[n] = half[:max(0, len(half) - n // 2)] * _power(n // 2) + half[n // 2:]
        m, k = max(0, len(h) - WINDOW + 1), max(0, len(h) - K + 1)
        return {K: mix64(r[8][:k] * _power(4) + r[4][8:8 + k]),
                WINDOW: mix64(r[32][:m] * _power(18) + r[16][32:32 + m] * _power(2) + r[2][48:48 + m])}


class Units:
    """The units of the texts whose words are ``h``: ``anchor`` and
    ``content`` fingerprints, ``first`` window, ``count`` of windows and
    number of the text."""

    def __init__(self, h: np.ndarray, text: np.ndarray, frequent: np.ndarray):
        self.h = h
        self.anchor = self.content = np.zeros(0, _U)
        self.first = self.count = self.text = np.zeros(0, np.int64)
        m = len(h) - WINDOW + 1
        if m <= 0:
            return
        r = _rolling(h)
        v = r[K] >> _U(1)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, r[K]), len(frequent) - 1)
            v |= (frequent[at] == r[K]).astype(_U) << _U(63)
        for step in (1, 2, 4, 8, 16):
            v = np.minimum(v[:-step], v[step:])
        v = np.minimum(v[:m], v[SPAN - 32:SPAN - 32 + m])
        s = np.flatnonzero(text[:m] == text[WINDOW - 1:])
        if not len(s):
            return
        v = v[s]
        run = np.concatenate(([True], (v[1:] != v[:-1]) | (s[1:] != s[:-1] + 1)))
        head = np.flatnonzero(run)
        place = np.arange(len(s)) - np.repeat(head, np.diff(np.concatenate((head, [len(s)]))))
        u = np.flatnonzero(place % SPAN == 0)
        self.first = s[u]
        self.count = np.diff(np.concatenate((u, [len(s)])))
        self.text = text[self.first]
        with np.errstate(over="ignore"):
            self.anchor = mix64(v[u] + _U(1))
            a, b = r[WINDOW][self.first], r[WINDOW][self.first + self.count - 1]
            self.content = mix64(a * _U(0x9E3779B97F4A7C15) + (b ^ _U(0x5555)) * _U(0xD6E8FEB86659FD93) + self.count.astype(_U) * _U(0xC2B2AE3D27D4EB4F))

    def segments(self, units: np.ndarray) -> list[bytes]:
        """The words of the given units, six bytes each."""
        six = np.ascontiguousarray(self.h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
        return [six[a:a + n + WINDOW - 1].tobytes() for a, n in zip(self.first[units].tolist(), self.count[units].tolist())]


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _pieces(batches, at: int):
    """(slice of rows, words, text numbers) of about a megabyte of text."""
    for piece in slices(batches, "text", 1 << 20):
        yield piece, *words(*text_buffers(piece.column(at)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


# ---- steps 1 and 2 --------------------------------------------------------------------

def frequent_grams(docs: DataFrame, chunk: int = 2_000_000) -> np.ndarray:
    """Hashes of the K-grams that make up a 2^-SHARE share of all words or
    more, as the tasks report them: at most 2^SHARE numbers. They choose
    anchors only; no result hangs on them."""
    def count(batches):
        held, size = [], 0

        def report():
            g, n = np.unique(np.concatenate(held), return_counts=True)
            some = n >= max(8, n.sum() >> (SHARE + 1))
            held.clear()
            return pa.RecordBatch.from_arrays([_signed(np.append(g[some], _U(0))), pa.array(np.append(n[some], 0)), pa.array(np.append(np.zeros(some.sum(), np.int64), n.sum()))], names=["gram", "n", "words"])

        for _, h, text in _pieces(batches, 0):
            if len(h) >= K:
                held.append(_rolling(h)[K][text[:len(h) - K + 1] == text[K - 1:]])
                size += len(held[-1])
            if size >= chunk:
                yield report()
                size = 0
        if size:
            yield report()

    seen = written(docs.select("text").mapInArrow(count, "gram long, n long, words long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "passage_grams")
    total = seen.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    got = seen.filter((F.col("n") > 0) & (F.col("n") * (1 << SHARE) >= total)).select("gram").toArrow()["gram"].combine_chunks()
    return np.sort(got.to_numpy().view(_U))


def shared_anchors(docs: DataFrame, frequent, flush: int = 1_000_000) -> DataFrame:
    """(doc, row, anchor) of the anchors that several documents have.
    ``docs``: doc, row, text."""
    schema = "doc long, row long, anchor long, several boolean, known boolean"

    def local(batches):
        held, size = [], 0

        def settle():
            anchor, doc, row = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((row, doc, anchor))
            anchor, doc, row = anchor[order], doc[order], row[order]
            new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])))
            anchor, doc, row = anchor[new], doc[new], row[new]
            head = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
            size = np.diff(np.concatenate((head, [len(anchor)])))
            last = head + size - 1
            many = doc[last] != doc[head]
            known = np.repeat(many, size)
            # Where the task knows already, one row says so to the other tasks.
            mark = head[many]
            cols = [np.concatenate((c, c[mark])) for c in (doc, row, anchor)]
            flags = [np.concatenate((known, np.ones(len(mark), bool))), np.concatenate((known, np.zeros(len(mark), bool)))]
            for a in range(0, len(cols[0]), 1 << 17):
                d, r, x = (c[a:a + (1 << 17)] for c in cols)
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(r), _signed(x), *(pa.array(f[a:a + (1 << 17)]) for f in flags)], names=["doc", "row", "anchor", "several", "known"])

        for piece, h, text in _pieces(batches, 2):
            u = Units(h, text, frequent.value)
            held.append((u.anchor, _ids(piece.column(0))[u.text], _ids(piece.column(1))[u.text]))
            size += len(u.anchor)
            if size >= flush:
                yield from settle()
                size = 0
        if size:
            yield from settle()

    found = written(docs.select("doc", "row", "text").mapInArrow(local, schema), "passage_anchors")
    open_ = found.filter(~F.col("known"))
    # A task sends at most one row for an anchor and row; marks settle the hot ones.
    groups = open_.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.max("several").alias("several")).filter("several OR a <> b").select("anchor")
    between = open_.filter(~F.col("several")).join(groups, "anchor", "left_semi")
    return found.filter("known").select("doc", "row", "anchor").unionByName(between.select("doc", "row", "anchor"))


# ---- step 3: the index of a shard -----------------------------------------------------

class Wavelet:
    """Wavelet matrix of numbers below 2^levels: bits in words of 64 with the
    counts before each."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.bits, self.ones, self.zeros = levels, [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (values >> level) & 1
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[:len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            self.bits.append(packed)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)[:-1])).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, value: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How often each value stands before each place; ``start`` is where
        the value's own run begins on the last level."""
        at = at.astype(np.int64)
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            low = (_U(1) << (at & 63).astype(_U)) - _U(1)
            one = self.ones[i][word] + np.bitwise_count(self.bits[i][word] & low)
            at = np.where((value >> level) & 1, self.zeros[i] + one, at - one)
        return at - start


def suffix_order(text: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and the border lengths of neighbours (the first is
    0). Every text ends with a number of its own that occurs once, and no
    stretch between two of these is longer than ``longest``; so doubling
    stops when all ranks differ."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    levels = [rank]
    step = 1
    while step <= longest and rank.max() < n - 1:
        key = rank * (n + 1)
        key[:n - step] += rank[step:] + 1
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        levels.append(rank)
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    # Borders from the ranks of each doubling, longest first.
    a, b = order[:-1].copy(), order[1:].copy()
    border = np.zeros(n - 1, np.int64)
    for i in range(len(levels) - 2, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[inside] = levels[i][a[inside]] == levels[i][b[inside]]
        border += same << i
        a += same << i
        b += same << i
    return order, np.concatenate(([0], border)) if n else border


class LeastBelow:
    """Least number of any range, from the least of all ranges of a power of
    two."""

    def __init__(self, values: np.ndarray):
        self.table = [values.astype(np.int32)]
        while 2 << (len(self.table) - 1) <= len(values):
            half = 1 << (len(self.table) - 1)
            t = self.table[-1]
            self.table.append(np.minimum(t[:-half], t[half:]))
        self.flat = np.zeros((len(self.table), len(values)), np.int32)
        for i, t in enumerate(self.table):
            self.flat[i, :len(t)] = t
        self.table = None

    def reach(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last place up to ``lo`` and the first from ``hi`` on with a
        number below ``depth`` (both ends of the table have one)."""
        n = self.flat.shape[1]
        for level in range(len(self.flat) - 1, -1, -1):
            size, t = 1 << level, self.flat[level]
            lo = np.where((lo + 1 >= size) & (t[np.maximum(lo + 1 - size, 0)] >= depth), lo - size, lo)
            hi = np.where((hi + size <= n) & (t[np.minimum(hi, n - size)] >= depth), hi + size, hi)
        return lo, hi

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = (np.frexp((hi - lo).astype(np.float64))[1] - 1).astype(np.int64)
        return np.minimum(self.flat[level, lo], self.flat[level, hi - (1 << level)])


class ShardIndex:
    """FM-index of distinct segments (arrays of word fingerprints) with the
    rank of the least document that has each."""

    def __init__(self, segments: list[np.ndarray], owner: np.ndarray):
        sizes = np.array([len(s) for s in segments])
        self.n = int(sizes.sum()) + len(segments)
        self.words, ids = np.unique(np.concatenate(segments), return_inverse=True)
        ends = np.cumsum(sizes + 1) - 1
        inner = np.ones(self.n, bool)
        inner[ends] = False
        text = np.empty(self.n, np.int64)
        text[inner] = ids + len(segments)
        text[ends] = np.arange(len(segments))           # each end is a number of its own
        order, border = suffix_order(text, int(sizes.max()) + 1)
        symbol = np.where(inner, text - len(segments) + 1, 0)
        before = symbol[order - 1]                        # the last transform; ends are all 0
        self.levels = max(1, int(len(self.words)).bit_length())
        self.wavelet = Wavelet(before, self.levels)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbol, minlength=len(self.words) + 1))))
        # Where each word's run begins on the wavelet matrix's last level.
        reverse = np.zeros(len(self.words) + 1, np.int64)
        value = np.arange(len(self.words) + 1)
        for _ in range(self.levels):
            reverse = (reverse << 1) | (value & 1)
            value >>= 1
        count = np.bincount(before, minlength=len(self.words) + 1)
        by = np.argsort(reverse)
        self.start = np.empty(len(reverse), np.int64)
        self.start[by] = np.concatenate(([0], np.cumsum(count[by])[:-1]))
        self.border = np.append(border, 0)
        self.borders = LeastBelow(self.border)
        self.least = LeastBelow(np.repeat(owner, sizes + 1)[order])

    def extend(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of word + match: one backward-search step."""
        both = self.wavelet.rank(np.concatenate((word, word)), np.concatenate((lo, hi)), self.start[np.concatenate((word, word))])
        return self.first[word] + both[:len(word)], self.first[word] + both[len(word):]

    def shorten(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The enclosing interval of the suffix tree, and its depth."""
        depth = np.maximum(self.border[lo], self.border[hi])
        lo, hi = self.borders.reach(lo, hi, depth)
        return np.where(depth == 0, 0, lo), np.where(depth == 0, self.n, hi), depth

    def statistics(self, segments: list[np.ndarray], owner: np.ndarray, most: int):
        """Streams segments backwards; yields (lanes, place, length): at each
        place the longest match with a smaller owner's text."""
        sizes = np.array([len(s) for s in segments])
        flat = np.searchsorted(self.words, np.concatenate(segments)) + 1
        begin = np.cumsum(sizes) - sizes
        lo, hi = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n)
        length = np.zeros(len(sizes), np.int64)
        for back in range(1, most + 1):
            lanes = np.flatnonzero(sizes >= back)
            word = flat[begin[lanes] + sizes[lanes] - back]
            todo = np.arange(len(lanes))
            while len(todo):
                at = lanes[todo]
                a, b = self.extend(word[todo], lo[at], hi[at])
                fits = b > a
                fits[fits] = self.least(a[fits], b[fits]) < owner[at[fits]]
                yes = at[fits]
                lo[yes], hi[yes] = a[fits], b[fits]
                length[yes] += 1
                todo = todo[~fits]
                at = lanes[todo]
                stuck = length[at] == 0
                todo, at = todo[~stuck], at[~stuck]
                lo[at], hi[at], length[at] = self.shorten(lo[at], hi[at])
            yield lanes, sizes[lanes] - back, length[lanes]


def repeated(segments: list[np.ndarray], anchor: np.ndarray, content: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each (segment, document) of a shard the windows that a smaller
    document has, as bits from the first window on. Equal contents are equal
    segments. The least document of an anchor is not streamed: its windows
    can only be in segments of that anchor."""
    distinct, first, which = np.unique(content, return_index=True, return_inverse=True)
    docs, rank = np.unique(doc, return_inverse=True)
    least = np.full(len(distinct), len(docs), np.int64)
    np.minimum.at(least, which, rank)
    own = [segments[i] for i in first]
    # One lane for each content and document; rows of one document share it.
    groups, group = np.unique(anchor, return_inverse=True)
    lowest = np.full(len(groups), len(docs), np.int64)
    np.minimum.at(lowest, group, rank)
    bits = np.zeros(len(segments), np.int64)
    rest = np.flatnonzero(rank > lowest[group])
    if len(rest):
        lane, back = np.unique(which[rest] * len(docs) + rank[rest], return_inverse=True)
        mine = np.zeros(len(lane), np.int64)
        index = ShardIndex(own, least)
        for at, place, length in index.statistics([own[i] for i in lane // len(docs)], lane % len(docs), max(len(s) for s in own)):
            hit = length >= WINDOW
            mine[at[hit]] |= np.int64(1) << place[hit]
        bits[rest] = mine[back]
    return bits


# ---- step 3 on Spark --------------------------------------------------------------------

def repeated_windows(marked: DataFrame, frequent, flush: int = 60_000, shard: int = SHARD) -> DataFrame:
    """(doc, row, unit, bits): the units that have repeated windows, by the
    fingerprint of anchor and content. ``marked``: doc, row, text, anchors
    (the shared ones)."""
    schema = "anchor long, content long, doc long, row long, segment binary, bits long"

    def local(batches):
        held, size = [], 0

        def settle():
            anchor, content, doc, row = (np.concatenate(c) for c in list(zip(*held))[:4])
            segment = [s for x in held for s in x[4]]
            held.clear()
            order = np.lexsort((row, doc, content, anchor))
            anchor, content, doc, row = anchor[order], content[order], doc[order], row[order]
            unit = np.concatenate(([True], (content[1:] != content[:-1]) | (anchor[1:] != anchor[:-1])))
            new = unit | np.concatenate(([True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])))
            least = doc[np.maximum.accumulate(np.where(unit, np.arange(len(unit)), 0))]
            # Copies match the task's least document in full.
            out = [(a, c, d, r, segment[i] if d == m else None, None if d == m else (1 << (len(segment[i]) // 6 - WINDOW + 1)) - 1)
                   for a, c, d, r, m, i, x in zip(anchor.view(np.int64).tolist(), content.view(np.int64).tolist(), doc.tolist(), row.tolist(), least.tolist(), order.tolist(), new.tolist()) if x]
            types = [pa.int64()] * 4 + [pa.binary(), pa.int64()]
            for k in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k:k + 4096]), types)], names=[x.split()[0] for x in schema.split(", ")])

        for piece, h, text in _pieces(batches, 2):
            u = Units(h, text, frequent.value)
            mine = _marked(u, piece.column(3))
            if len(mine):
                t = u.text[mine]
                held.append((u.anchor[mine], u.content[mine], _ids(piece.column(0))[t], _ids(piece.column(1))[t], u.segments(mine)))
                size += len(mine)
            if size >= flush:
                yield from settle()
                size = 0
        if size:
            yield from settle()

    def between(batches):
        held, size, last = [], 0, None

        def search():
            anchor, content, doc, row, segment = zip(*held)
            held.clear()
            segments = []
            for s in segment:
                wide = np.zeros((len(s) // 6, 8), np.uint8)
                wide[:, :6] = np.frombuffer(s, np.uint8).reshape(-1, 6)
                segments.append(wide.view("<u8").ravel())
            anchor, content = np.array(anchor), np.array(content)
            bits = repeated(segments, anchor, content, np.array(doc))
            hit = np.flatnonzero(bits)
            key = unit_key(anchor.view(_U), content.view(_U))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(doc)[hit]), pa.array(np.array(row)[hit]), _signed(key[hit]), pa.array(bits[hit])], names=["doc", "row", "unit", "bits"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if size >= shard and r[0] != last:
                    yield from search()
                    size = 0
                held.append(r[:5])
                size += len(r[4]) // 6
                last = r[0]
        if held:
            yield from search()

    found = written(marked.mapInArrow(local, schema), "passage_segments")
    streamed = found.filter("segment IS NOT NULL").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(between, "doc long, row long, unit long, bits long")

    def name(batches):
        for b in batches:
            key = unit_key(_ids(b.column(2)).view(_U), _ids(b.column(3)).view(_U))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _signed(key), b.column(4)], names=["doc", "row", "unit", "bits"])

    copies = found.filter("segment IS NULL").select("doc", "row", "anchor", "content", "bits").mapInArrow(name, "doc long, row long, unit long, bits long")
    return streamed.unionByName(copies)


def unit_key(anchor: np.ndarray, content: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(anchor * _U(0x9E3779B97F4A7C15) + content)


def _marked(u: Units, lists: pa.Array) -> np.ndarray:
    """Units of each row whose anchor is in the row's list."""
    if not len(u.anchor):
        return u.text
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy().view(_U)
    row = np.repeat(np.arange(len(counts)), counts)
    anchors, number = np.unique(np.concatenate((flat, u.anchor)), return_inverse=True)
    there = row * len(anchors) + number[:len(flat)]
    return np.flatnonzero(np.isin(u.text * len(anchors) + number[len(flat):], there))


# ---- step 4 and the operator -------------------------------------------------------------

OUT = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept binary"


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, spans (removed words, maximal, half open) and kept
    (the remaining words, joined by one blank, as UTF-8)."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), "text").withColumn("row", F.xxhash64("doc", "text"))
    frequent = spark.sparkContext.broadcast(frequent_grams(docs))
    anchors = shared_anchors(docs, frequent).groupBy("doc", "row").agg(F.collect_set("anchor").alias("anchors"))
    marked = docs.join(anchors, ["doc", "row"]).select("doc", "row", "text", "anchors")
    found = repeated_windows(marked, frequent).groupBy("doc", "row", "unit").agg(F.bit_or("bits").alias("bits"))
    found = found.groupBy("doc", "row").agg(F.collect_list(F.struct("unit", "bits")).alias("units"))
    both = docs.join(found, ["doc", "row"], "left").select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "text", "units.unit", "units.bits")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for piece, h, text in _pieces(batches, 1):
            gone = np.zeros(len(h) + 1, np.int64)
            has = piece.column(2).is_valid().to_numpy(zero_copy_only=False)
            if has.any():
                u = Units(h, text, frequent.value)
                key = unit_key(u.anchor, u.content)
                lists = [np.array(x or (), np.int64) for x in piece.column(2).to_pylist()]
                bits = [np.array(x or (), np.int64) for x in piece.column(3).to_pylist()]
                border = np.searchsorted(u.text, np.arange(piece.num_rows + 1))
                for i in np.flatnonzero(has):
                    by = np.argsort(lists[i].view(_U))
                    known = lists[i].view(_U)[by]
                    at = np.arange(border[i], border[i + 1])
                    where = np.minimum(np.searchsorted(known, key[at]), len(known) - 1)
                    hit = known[where] == key[at]
                    at, mask = at[hit], bits[i][by[where[hit]]]
                    for k in range(SPAN):
                        first = u.first[at[(mask >> k) & 1 == 1]] + k
                        np.add.at(gone, first, 1)
                        np.add.at(gone, first + WINDOW, -1)
            mark = np.cumsum(gone[:-1]) > 0
            border = np.searchsorted(text, np.arange(piece.num_rows + 1))
            spans, kept = [], []
            for i, t in enumerate(piece.column(1).cast(pa.binary()).to_pylist()):
                own = (t or b"").split()
                here = mark[border[i]:border[i + 1]]
                if here.any():
                    turn = np.flatnonzero(np.diff(np.concatenate(([0], here.astype(np.int8), [0]))))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)])
                    own = [w for w, x in zip(own, here.tolist()) if not x]
                else:
                    spans.append([])
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(border)), pa.array(spans, span_type), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "spans", "kept"])

    return both.mapInArrow(cut, OUT)
