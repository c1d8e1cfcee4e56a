"""LM scoring by context-tree weighting.

Each byte of a text is eight binary decisions. A decision is predicted in
the context of the 0 .. ``depth`` bytes before it; every node of that
context tree holds a Krichevsky-Trofimov estimate from the training
counts, and the estimates of all depths are mixed by context-tree
weighting: P_w(s) = 1/2 P_kt(s) + 1/2 prod P_w(children of s). Contexts seen
fewer than ``least`` times share one leaf below the longest context that was
seen that often, so no count is dropped; there is no other limit, and the
tree grows with the corpus.

How it runs on Spark
--------------------
The tree is a table, never in one place. A *cell* is a context and a binary
node; only cells with counts exist.

1. *Counts.* Each task sends one row for each distinct (context, byte) gram
   of its training texts; Spark sums them.
2. *Below.* Grams are dealt by the three nearest context bytes: all contexts
   of depth three and more that share them lie together (at most 2^24 grams
   at the default depth, taken a few such groups at a time). Tasks weigh
   their cells from the deepest up, and what they say of depth three is
   summed by its cell of depth two.
3. *Top.* Cells of depths 0 to 2 are bounded by the alphabet, not by the
   corpus (at most 2^16 contexts; text has a few thousand): the driver
   weighs and mixes them, and they are broadcast.
4. *Answers.* Texts are laid in blocks of ``BLOCK_MB``. The distinct grams of
   all blocks are dealt like the counts and answered once each from the top
   down; answers go back to the blocks that asked, by a join on the gram.
5. *Scoring.* A block meets its answers; a byte is one look-up.

A text is closed by one end symbol, so probabilities of all texts sum
to 1. Null texts are empty; an empty table gives an empty result, and
without training texts every byte costs 8 bits; repeated rows are scored
each; a very long text is a block of its own.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import give_back, id_crc, slices, text_buffers, written

END = 0xFF                     # never a byte of UTF-8
END_TOKEN = b"\n"              # never a word
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

DEPTH = 5
LEAST = 2                 # a context is a node of its own from so many bytes on
TOP = 3                   # depths below are in the broadcast part of the tree
BLOCK_MB = 32
PIECE = 1 << 18           # bytes of text scored at a time
GROUP = 1 << 17           # grams a task takes at a time, whole groups
COMMON = 1 << 17          # words broadcast for the base score, the most frequent ones


# ---- text layout ------------------------------------------------------------

def stream(data: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte stream: ``depth`` end marks, the text, one end
    mark; and the positions at which each text starts (its end mark follows
    the text)."""
    n = len(off) - 1
    lens = np.diff(off)
    starts = off[:-1] + (depth + 1) * np.arange(n, dtype=np.int64) + depth
    out = np.full(len(data) + n * (depth + 1), END, np.uint8)
    at = np.arange(len(data), dtype=np.int64) + np.repeat((starts - off[:-1]), lens)
    out[at] = data
    return out, starts


def gram_keys(data: np.ndarray, off: np.ndarray, depth: int) -> np.ndarray:
    """The (context of ``depth`` bytes, byte) grams of all texts in their
    order, a text's length and one each; the byte is the lowest of the key."""
    s, starts = stream(data, off, depth)
    if not len(s):
        return np.zeros(0, np.uint64)
    key = np.zeros(len(s) - depth, np.uint64)
    for j in range(depth + 1):
        key <<= np.uint64(8)
        key |= s[j:len(s) - depth + j]
    real = np.ones(len(key), bool)      # pads are contexts, never predicted
    ends = starts[:-1] + np.diff(off)[:-1] + 1
    for j in range(depth):
        real[ends + j - depth] = False
    return key[real]


def _heads(key: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)


def grams(data: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and their counts."""
    key = gram_keys(data, off, depth)
    key.sort()
    first = _heads(key)
    return key[first], np.diff(np.concatenate((first, [len(key)])))


# ---- cells --------------------------------------------------------------------

def _lgamma(z: np.ndarray) -> np.ndarray:
    """log Gamma for z > 0 by Stirling's series after a shift by 8."""
    shift = np.ones_like(z)
    for k in range(8):
        shift *= z + k
    x = z + 8
    i = 1 / x
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + i * (1 / 12 - i * i * (1 / 360 - i * i / 1260)) - np.log(shift)


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1) - math.log(math.pi)


def _kt_one(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return (n1 + 0.5) / (n0 + n1 + 1)


def _low(key: np.ndarray, n_bytes: int) -> np.ndarray:
    return key & np.uint64((1 << (8 * n_bytes)) - 1) if n_bytes < 8 else key


_BYTE = np.uint64(255)


def _node(byte: np.ndarray, j: int) -> np.ndarray:
    """The node of a byte's decision j: a one, then the j bits before it."""
    return np.uint64(1 << j) | (byte >> np.uint64(8 - j))


def _bit(byte: np.ndarray, j: int) -> np.ndarray:
    return (byte >> np.uint64(7 - j)) & np.uint64(1)


def find(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted table, -1 where it is not."""
    if not len(table):
        return np.full(len(key), -1)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return np.where(table[at] == key, at, -1)


class Level:
    """The contexts of one depth that are nodes of their own (``ctx``, shifted
    past a byte) and their cells: ``cell`` is context and node, sorted; ``n0``
    and ``n1`` count the decisions. Weighing and mixing add ``pw`` (log P_w),
    ``acc`` and ``rem`` (the mixture down to this depth, and the weight left
    for deeper ones) and ``one`` (the probability of a one where no deeper
    context is a node)."""

    def __init__(self, depth: int, key: np.ndarray, n: np.ndarray, least: int):
        self.depth = depth
        ctx = key & ~_BYTE
        head = _heads(ctx)
        size = np.diff(np.concatenate((head, [len(ctx)])))
        total = np.add.reduceat(n, head) if len(head) else np.zeros(0, n.dtype)
        own = total >= least if depth else np.ones(len(head), bool)
        self.ctx = ctx[head][own]
        own = np.repeat(own, size)
        key, n = key[own], n[own].astype(np.float64)
        ctx, byte = key & ~_BYTE, key & _BYTE
        cell, every, ones = [], [], []
        for j in range(8):
            c = ctx | _node(byte, j)
            first = _heads(c)
            cell.append(c[first])
            every.append(np.add.reduceat(n, first) if len(first) else n)
            ones.append(np.add.reduceat(n * _bit(byte, j), first) if len(first) else n)
        cell, every, ones = (np.concatenate(x) for x in (cell, every, ones))
        order = np.argsort(cell)
        self.cell, self.n1 = cell[order], ones[order]
        self.n0 = every[order] - self.n1

    def weigh(self, below) -> None:
        """``below``: cells of this depth, and sums of their children's log
        P_w, zeros and ones; None at the greatest depth."""
        own = _log_kt(self.n0, self.n1)
        if below is None:
            self.r0 = self.r1 = np.zeros(len(own))
            self.pw, self.w = own, np.ones(len(own))
            return
        cell, *sums = below
        at = np.searchsorted(self.cell, cell)
        kids, k0, k1 = (np.bincount(at, x, len(own)) for x in sums)
        self.r0, self.r1 = np.maximum(self.n0 - k0, 0), np.maximum(self.n1 - k1, 0)
        self.pw = np.logaddexp(own, kids + _log_kt(self.r0, self.r1)) - math.log(2)
        self.w = np.exp(own - math.log(2) - self.pw)

    def parents(self) -> np.ndarray:
        """The cell of one depth less that each cell belongs to."""
        return _low(self.cell, self.depth)

    def mix(self, up: Level | None) -> None:
        acc, rem = 0.0, 1.0
        if up is not None:
            at = np.searchsorted(up.cell, self.parents())
            acc, rem = up.acc[at], up.rem[at]
        self.acc = acc + rem * self.w * _kt_one(self.n0, self.n1)
        self.rem = rem * (1 - self.w)
        self.one = self.acc + self.rem * _kt_one(self.r0, self.r1)


def tree(key: np.ndarray, n: np.ndarray, lo: int, hi: int, least: int, below=None) -> list[Level]:
    """Weighed levels lo .. hi of the grams (sorted or not) of depth ``hi``."""
    levels = []
    for d in range(hi, lo - 1, -1):
        key = _low(key, d + 1)
        key, n = added([(key, n)])
        levels.append(Level(d, key, n, least))
    for x in levels:
        x.weigh(below)
        below = (x.parents(), x.pw, x.n0, x.n1)
    return levels[::-1]


def answers(levels: list[Level], key: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each gram's byte in its context, by
    mixed levels from the empty context on."""
    byte = key & _BYTE
    total = np.zeros(len(key))
    inside, known = [], np.ones(len(key), bool)
    for x in levels:
        known = known & (find(x.ctx, _low(key, x.depth + 1) & ~_BYTE) >= 0)
        inside.append(known)
    for j in range(8):
        one = np.full(len(key), 0.5)
        acc, rem, on = np.zeros(len(key)), np.ones(len(key)), np.ones(len(key), bool)
        for x, known in zip(levels, inside):
            rows = np.flatnonzero(on & known)
            at = find(x.cell, (_low(key[rows], x.depth + 1) & ~_BYTE) | _node(byte[rows], j))
            new = rows[at < 0]                 # no decision seen here, nor deeper
            one[new], on[new] = acc[new] + 0.5 * rem[new], False
            rows, at = rows[at >= 0], at[at >= 0]
            one[rows], acc[rows], rem[rows] = x.one[at], x.acc[at], x.rem[at]
            on &= known
        one = np.clip(one, 1e-12, 1 - 1e-12)
        total += np.log(np.where(_bit(byte, j) == 1, one, 1 - one))
    return total


# ---- Spark operator ----------------------------------------------------------

def _arrow(names: str, *columns):
    """Record batches of at most 2^18 rows."""
    for a in range(0, len(columns[0]), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(c[a:a + (1 << 18)]) for c in columns], names=names.split())


def added(held: list) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (keys, counts) by key, sorted."""
    key, n = (np.concatenate(c) for c in zip(*held))
    order = np.argsort(key)
    key = key[order]
    first = _heads(key)
    return key[first], np.add.reduceat(n[order], first) if len(first) else n


class _Sums:
    """Gram counts of texts, piece by piece, in bounded memory."""

    def __init__(self, depth: int, most: int):
        self.depth, self.most, self.held = depth, most, []

    def add(self, column) -> bool:
        """True when there is enough to be sent."""
        self.held.append(grams(*text_buffers(column), self.depth))
        if len(self.held) > 1 and sum(len(k) for k, _ in self.held[1:]) > max(1 << 20, len(self.held[0][0])):
            self.held = [added(self.held)]
        return len(self.held[0][0]) > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        held, self.held = self.held, []
        return added(held) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def gram_counts(docs: DataFrame, depth: int, text: str = "text", piece_mb: int = 2, most: int = 3_000_000) -> DataFrame:
    """(gram, n) of all texts, written: the grams of the greatest depth as
    longs, and how often they occur."""
    def count(batches):
        sums = _Sums(depth, most)
        for piece in slices(batches, text, piece_mb << 20):
            if sums.add(piece.column(0)):
                key, n = sums.take()
                yield from _arrow("gram n", key.view(np.int64), n)
        key, n = sums.take()
        yield from _arrow("gram n", key.view(np.int64), n)

    sent = docs.select(text).mapInArrow(count, "gram long, n long")
    return written(sent.groupBy("gram").agg(F.sum("n").alias("n")), "ctw_grams")


def blocks(docs: DataFrame, block_mb: int = BLOCK_MB) -> DataFrame:
    """``docs`` (doc_id, text, held_out) with a row number and the number of
    its block, written: the texts of a block hold at most about ``block_mb``."""
    def lay(batches):
        part = TaskContext.get().partitionId()
        row, block, size = part << 40, part << 24, 0
        for piece in slices(batches, "text", 1 << 20):
            size += piece.column(1).nbytes
            if size > block_mb << 20:
                block, size = block + 1, piece.column(1).nbytes
            n = piece.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(row, row + n)), *piece.columns],
                                             names=["block", "row", "doc_id", "text", "held_out"])
            row += n

    return written(docs.select(F.col("doc_id").cast("long"), "text", "held_out")
                   .mapInArrow(lay, "block long, row long, doc_id long, text string, held_out boolean"), "ctw_blocks")


def block_grams(laid: DataFrame, depth: int, piece_mb: int = 2, most: int = 3_000_000) -> DataFrame:
    """(block, gram), written: the distinct grams of each block (twice where
    two tasks read parts of one)."""
    def ask(batches):
        sums, block = _Sums(depth, most), None

        def flush():
            key, _ = sums.take()
            yield from _arrow("block gram", np.full(len(key), block), key.view(np.int64))

        for piece in slices(batches, "text", piece_mb << 20):
            ids = piece.column(0).to_numpy()
            cut = np.concatenate((_heads(ids), [len(ids)]))
            for a, b in zip(cut[:-1], cut[1:]):
                if block is not None and ids[a] != block:
                    yield from flush()
                block = int(ids[a])
                if sums.add(piece.column(1).slice(a, b - a)):
                    yield from flush()
        if block is not None:
            yield from flush()

    return written(laid.select("block", "text").mapInArrow(ask, "block long, gram long"), "ctw_asked")


def _groups(batches, size: int):
    """(grams, counts) of whole groups, at least ``size`` grams at a time;
    the batches are sorted by group."""
    key, n, rows = [], [], 0

    def near(k):
        return (k >> np.uint64(8)) & np.uint64(0xFFFFFF)

    for b in batches:
        if not b.num_rows:
            continue
        key.append(b.column(0).to_numpy().view(np.uint64))
        n.append(b.column(1).to_numpy())
        rows += b.num_rows
        if rows >= size:
            k, c = np.concatenate(key), np.concatenate(n)
            end = int(np.flatnonzero(near(k) != near(k[-1:]))[-1]) + 1 if (near(k) != near(k[-1:])).any() else 0
            if end:
                yield k[:end], c[:end]
            key, n, rows = [k[end:]], [c[end:]], len(k) - end
    if rows:
        yield np.concatenate(key), np.concatenate(n)
    give_back()


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (gram, n) dealt and sorted by the three nearest context bytes."""
    near = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(0xFFFFFF))
    return rows.select("gram", "n").repartition(near).sortWithinPartitions(near)


def top_levels(counts: DataFrame, depth: int, least: int) -> list[Level]:
    """Mixed levels of the depths below ``TOP``, from the counts of all."""
    def weigh(batches):
        for key, n in _groups(batches, GROUP):
            low = tree(key, n, TOP, depth, least)[0]
            cell = low.parents()
            order = np.argsort(cell, kind="stable")
            first = _heads(cell[order])
            if len(first):
                yield from _arrow("cell pw n0 n1", cell[order][first].view(np.int64),
                                  *(np.add.reduceat(x[order], first) for x in (low.pw, low.n0, low.n1)))

    below = (_dealt(counts).mapInArrow(weigh, "cell long, pw double, n0 double, n1 double")
             .groupBy("cell").agg(F.sum("pw").alias("pw"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow())
    short = F.col("gram").bitwiseAND(F.lit((1 << (8 * TOP)) - 1))
    got = counts.groupBy(short.alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    levels = tree(got["gram"].to_numpy().view(np.uint64), got["n"].to_numpy(), 0, TOP - 1, least,
                  (below["cell"].to_numpy().view(np.uint64), *(below[c].to_numpy() for c in ("pw", "n0", "n1"))))
    for up, x in zip([None, *levels], levels):
        x.mix(up)
        del x.n0, x.n1, x.r0, x.r1, x.pw, x.w           # not needed to answer
    return levels


def gram_scores(counts: DataFrame, asked: DataFrame, depth: int, least: int) -> DataFrame:
    """(gram, logp) of the grams of ``asked`` (gram, n; each once, n not
    positive): natural log of the byte's probability in its context, by the
    tree of ``counts``."""
    top = asked.sparkSession.sparkContext.broadcast(top_levels(counts, depth, least))

    def answer(batches):
        for key, n in _groups(batches, GROUP):
            seen = n > 0
            want = np.unique(key[~seen])
            if not len(want):
                continue
            levels = list(top.value)
            for x in tree(key[seen], n[seen], TOP, depth, least):
                x.mix(levels[-1])
                levels.append(x)
            yield from _arrow("gram logp", want.view(np.int64), answers(levels, want).astype(np.float32))

    return _dealt(counts.unionByName(asked.select("gram", "n"))).mapInArrow(answer, "gram long, logp float")


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words, split at ASCII white space, and one end."""
    out = text.translate(_LOWER).split()
    out.append(END_TOKEN)
    return out


def word_counts(docs: DataFrame, text: str = "text", most: int = 1 << 18) -> DataFrame:
    """(token, c) over all texts, added up in each task first."""
    def count(batches):
        seen: Counter = Counter()

        def flush():
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(seen.values(), pa.int64())], names=["token", "c"])
                seen.clear()

        for piece in slices(batches, text, 4 << 20):
            for t in piece.column(0).cast(pa.binary()).to_pylist():
                seen.update(words(t or b""))
                if len(seen) >= most:
                    yield from flush()
        yield from flush()

    return docs.select(text).mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def common_from(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` words of ``counts`` (token, c)
    reach. Of N tokens there are at most sqrt(2 N) different counts."""
    each = counts.groupBy("c").agg(F.count("*").alias("n")).toArrow()
    c, n = each["c"].to_numpy(), each["n"].to_numpy()
    down = np.argsort(-c)
    fit = int(np.searchsorted(np.cumsum(n[down]), most, side="right"))
    return int(c[down[fit - 1]]) if fit else int(c.max(initial=0)) + 1


def score(docs: DataFrame, training: DataFrame, depth: int = DEPTH, least: int = LEAST, block_mb: int = BLOCK_MB) -> DataFrame:
    """Score every text of ``docs`` (``doc_id``, ``text``, ``held_out``) by
    the model learnt from ``training``. ``depth`` is 3 to 7 (a gram is one
    long).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score (log10 probability), n_bytes and bits_per_byte (code length).

    The base score counts words exactly: the most frequent words (at most
    COMMON of them) are looked up in a broadcast table, all others by a join
    on the word."""
    if not TOP <= depth <= 7:
        raise ValueError("depth must be 3 to 7")
    spark = docs.sparkSession
    counts = gram_counts(training, depth)
    laid = blocks(docs, block_mb)
    # Dealt by gram once: the distinct grams and the join both read this shuffle
    # (the same columns and filter on either side, so that it is reused).
    asked = block_grams(laid, depth).filter("gram IS NOT NULL").repartition("gram")
    each = asked.groupBy("gram").agg((-F.min("block")).alias("n"))
    told = asked.join(gram_scores(counts, each, depth, least), "gram").select("block", "gram", "logp")
    word_table = written(word_counts(training), "ctw_words")
    total, distinct = word_table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    floor_c = common_from(word_table, COMMON)
    common = word_table.filter(F.col("c") >= floor_c).toArrow()
    table = spark.sparkContext.broadcast((common["token"].combine_chunks(), common["c"].to_numpy()))
    bottom = total + 0.1 * (distinct + 1)
    schema = "row long, doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base double, score double, tokens array<binary>, times array<long>"
    fields = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base", pa.float64()), ("score", pa.float64()), ("tokens", pa.list_(pa.binary())), ("times", pa.list_(pa.int64()))])
    state: dict = {}

    def run(texts: pa.Table, grams_told: pa.Table) -> pa.Table:
        if "get" not in state:
            tokens, c = table.value
            state["get"] = dict(zip(tokens.to_pylist(), np.log10((c + 0.1) / bottom).tolist())).get
        get = state["get"]
        place, logp = grams_told["gram"].to_numpy(), grams_told["logp"].to_numpy()
        order = np.argsort(place)
        place, logp = place[order], logp[order]
        done = []
        for piece in slices(texts.to_batches(), "text", PIECE):
            data, off = text_buffers(piece.column(3))
            key = gram_keys(data, off, depth).view(np.int64)
            order = np.argsort(key)
            each = np.empty(len(key))
            each[order] = logp[np.searchsorted(place, key[order])]          # every gram was asked for
            sc = np.add.reduceat(each / math.log(10), off[:-1] + np.arange(len(off) - 1))
            main = []
            rows, ids, held = (piece.column(i).to_pylist() for i in (1, 2, 4))
            for i, t in enumerate(piece.column(3).cast(pa.binary()).to_pylist()):
                w = words(t or b"")
                lp = list(map(get, w))
                rare: Counter = Counter()
                if None in lp:
                    rare = Counter(x for x, p in zip(w, lp) if p is None)
                    lp = [p for p in lp if p is not None]
                main.append((rows[i], ids[i], held[i], len(t or b""), len(w), len(lp), math.fsum(lp), float(sc[i]), list(rare), list(rare.values())))
            done.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*main), fields)], schema=fields))
        return pa.Table.from_batches(done, fields)

    met = laid.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)
    rows = written(met, "ctw_scored")
    hit = F.coalesce("c", F.lit(0))
    rare = (rows.select("row", F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("times").alias("times")))).join(word_table.filter(F.col("c") < floor_c), "token", "left")
            .groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
                                F.sum(F.col("times") * F.log10((hit + 0.1) / F.lit(bottom))).alias("rare_base")))
    out = rows.drop("tokens", "times").join(rare, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score", "n_bytes",
        F.when(F.col("n_bytes") > 0, -F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))


def held_out_split(docs: DataFrame, mod: int = 10, held: int = 0) -> DataFrame:
    """doc_id, text and the flag of the fixed split by the id's crc32."""
    return docs.select("doc_id", "text", (id_crc() % mod == held).alias("held_out"))
