"""Best-fit packing by non-negative least squares over length patterns.

Documents become token pieces of at most ``max_len``; pieces of a length
are interchangeable, so packing is decided on the histogram of lengths
(at most ``max_len`` numbers): all patterns of up to three lengths that
fill a sequence exactly are enumerated, non-negative least squares fits
how often each is used, the counts are rounded (from several fractions on,
the shortest plan is taken), and what is left is packed
best-fit-decreasing or by fullest subset sums, again on the histogram.

The plan is then dealt to the pieces: each piece gets its rank among the
pieces of its length, and an interval table (bounded by the number of
patterns in use) turns the rank into a sequence and a place in it. Ranks
come from two levels - counts of (length, salt), and a window inside
each salt - so a length that a third of all pieces share is split.
Pieces are written once before ranking, so a lost executor cannot change
them.

Null and empty texts are one end id. Empty tables give no pieces.
Repeated rows are packed each.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiforge.llm.common import slices, written

END_ID = 2
#: Fractions of a repeat count that are tried as the least to be rounded up; the shortest plan is taken.
ROUND_FROM = (0.5, 0.3, 0.15, 0.05)
SPECIAL = "<|endoftext|>"


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    ``path`` is a ``tokenizers`` file of a byte-level BPE. Where the same
    vocabulary lies beside it as ranks (``.tiktoken``), the ranks are run
    by tiktoken, which merges the same way in a quarter of the time; the
    tests hold both against each other. A text that tiktoken's pattern
    cannot split (some hundred thousand blanks in a row) goes to tokenizers,
    which also runs where there are no ranks."""

    def __init__(self, path: str):
        import os

        self._path, self._tokenizer, self._fast = path, None, None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                merge = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merge, special_tokens={SPECIAL: len(merge)})

    # Nothing here refers back to its encoder: a task's encoder goes when the task does, not with a later garbage collection.
    def _one(self, t: str) -> bytes:
        if self._fast is not None:
            try:
                return self._fast.encode_to_numpy(t, allowed_special="all").astype("<u4").tobytes()
            except ValueError:
                pass
        return self._slow(t)

    def _slow(self, text: str) -> bytes:
        if self._tokenizer is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self._path)
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._one(t) for t in texts]


PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def narrow(ids: bytes) -> bytes:
    """Ids at two bytes each where all are below 65,536, as they come else."""
    a = np.frombuffer(ids, "<u4")
    return a.astype("<u2").tobytes() if a.max() < 1 << 16 else ids


def pieces(docs: DataFrame, path: str, max_len: int = 1024, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Token pieces of each document: all but the first have ``max_len``
    tokens when it is longer. ``row`` numbers the rows of ``docs``;
    ``ids`` (with_ids) are the tokens themselves, as :func:`narrow` packs
    them, for :func:`widen`. Write it before use."""
    end = np.array([end_id], "<u4").tobytes()
    held: dict = {}

    def run(batches):
        if "e" not in held:
            held["e"] = Encoder(path)
        row = TaskContext.get().partitionId() << 40
        for piece in slices(batches, "text", 2 << 20):
            out = []
            for d, ids in zip(piece.column(0).to_pylist(), held["e"].encode([t or "" for t in piece.column(1).to_pylist()])):
                ids += end
                row += 1
                n = len(ids) // 4
                at = 0
                for k in range(-(-n // max_len)):
                    size = n - max_len * (-(-n // max_len) - 1) if k == 0 else max_len
                    part = ids[4 * at:4 * (at + size)]
                    out.append((row, d, k, at, size, zlib.crc32(part), *([narrow(part)] if with_ids else [])))
                    at += size
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def widen(ids: pa.Array, length: np.ndarray) -> tuple[pa.ListArray, pa.Array]:
    """Token ids of packed rows, and the crc32 of each row's ids as
    little-endian unsigned 32-bit numbers."""
    parts = [np.frombuffer(x, f"<u{len(x) // n}").astype("<u4") for x, n in zip(ids.to_pylist(), length.tolist())]
    ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(parts).view("<i4")), pa.array([zlib.crc32(x) for x in parts], pa.int64())


# ---- the plan, on the histogram ----------------------------------------------

def patterns(lengths: np.ndarray, max_len: int) -> np.ndarray:
    """All multisets of one to three of the given lengths that add up to
    ``max_len``, longest first, as rows padded with 0."""
    there = np.zeros(max_len + 1, bool)
    there[lengths] = True
    out = []
    if there[max_len]:
        out.append(np.array([[max_len, 0, 0]]))
    for a in np.flatnonzero(there[:max_len])[::-1]:
        rest = max_len - a
        b = np.flatnonzero(there[:min(a, rest) + 1])
        c = rest - b
        ok = (c <= b) & ((c == 0) | there[np.maximum(c, 0)])
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def nnls(pat: np.ndarray, want: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that minimises |A x - want| for the pattern matrix A, by
    accelerated projected gradients; A is only applied, never built."""
    n = len(want)
    weight = np.ones(n)
    weight[0] = 0.0

    def times(x):
        return np.bincount(pat.ravel(), np.repeat(x, pat.shape[1]), n) * weight

    def back(r):
        return (r * weight)[pat].sum(1)

    x = np.ones(len(pat))
    for _ in range(20):
        x = back(times(x))
        x /= np.linalg.norm(x)
    step = 1 / np.linalg.norm(back(times(x)))
    x = y = np.zeros(len(pat))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * back(times(y) - want), 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


@dataclass
class Plan:
    """``uses``: (lengths, repeats) in order of sequence numbers."""

    uses: list[tuple[tuple[int, ...], int]]

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.uses)

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """key = length << 40 | first rank (sorted), first sequence minus
        first rank, offset: one row for each place of each used pattern."""
        rank: dict[int, int] = {}
        rows, seq = [], 0
        for lengths, n in self.uses:
            offset = 0
            for length in lengths:
                first = rank.get(length, 0)
                rows.append((length << 40 | first, seq - first, offset))
                rank[length] = first + n
                offset += length
            seq += n
        rows.sort()
        k = np.array(rows, np.int64).reshape(-1, 3)
        return k[:, 0], k[:, 1], k[:, 2]


def solve(histogram: dict[int, int], max_len: int) -> Plan:
    """Plan for pieces counted by length: fit, round, pack the rest."""
    left = np.zeros(max_len + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    uses: list = []
    if left[max_len]:
        uses.append(((max_len,), int(left[max_len])))
        left[max_len] = 0
    pat = patterns(np.flatnonzero(left), max_len)
    x = nnls(pat, left.astype(float)) if len(pat) else np.zeros(0)
    plans = [rounded(pat, x, left, least, max_len, fullest) for least in ROUND_FROM for fullest in (False, True)]
    return Plan(uses + min(plans, key=lambda u: sum(n for _, n in u)))


def rounded(pat: np.ndarray, x: np.ndarray, left: np.ndarray, least: float, max_len: int, fullest: bool) -> list[tuple[tuple[int, ...], int]]:
    """Patterns by falling repeat counts, rounded up from a fraction of
    ``least``, as far as there are pieces for them; then the rest."""
    left, uses = left.copy(), []
    n = np.floor(x + 1 - least).astype(np.int64)
    for i in np.argsort(-x, kind="stable"):
        if x[i] < least:
            break
        lengths, times = np.unique(pat[i][pat[i] > 0], return_counts=True)
        k = int(min(n[i], (left[lengths] // times).min()))
        if k > 0:
            uses.append((tuple(int(v) for v in pat[i] if v), k))
            left[lengths] -= k * times
    return uses + best_fit(left, max_len, fullest)


def best_fit(left: np.ndarray, max_len: int, fullest: bool = False) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit-decreasing on counts: the longest piece left opens a
    sequence, the longest that still fits follows (with ``fullest``: those
    that fill it most), as often as there are pieces for it. Every step
    uses up a length."""
    left = left.copy()
    uses = []
    while left.any():
        first = int(np.flatnonzero(left)[-1])
        spare = left.copy()
        spare[first] -= 1
        take = [first, *(fill if fullest else greedy)(spare, max_len - first)]
        lengths, times = np.unique(take, return_counts=True)
        n = int((left[lengths] // times).min())
        left[lengths] -= n * times
        uses.append((tuple(take), n))
    return uses


def greedy(left: np.ndarray, free: int) -> list[int]:
    """The longest that fits, again and again."""
    left, take = left.copy(), []
    while len(fits := np.flatnonzero(left[:free + 1])):
        take.append(int(fits[-1]))
        left[take[-1]] -= 1
        free -= take[-1]
    return take


def fill(left: np.ndarray, free: int) -> list[int]:
    """Lengths whose sum is nearest below ``free`` or equal, long ones
    first: subset sums as bits of one number for each piece that counts."""
    items = [int(v) for v in np.flatnonzero(left[:free + 1]) for _ in range(min(int(left[v]), free // int(v)))]
    sums, mask = [1], (1 << (free + 1)) - 1
    for v in items:
        sums.append((sums[-1] | sums[-1] << v) & mask)
    rest = sums[-1].bit_length() - 1
    take = []
    for i in range(len(items) - 1, -1, -1):
        if rest >= items[i] and sums[i] >> (rest - items[i]) & 1:
            take.append(items[i])
            rest -= items[i]
    return take


# ---- dealing the plan to the pieces ------------------------------------------

def pack(docs: DataFrame, path: str, max_len: int = 1024, end_id: int = END_ID, with_ids: bool = False, per_salt: int = 250_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and
    ids: the tokens, and the digest is then taken from them as placed) of
    every piece. ``per_salt``: about so many pieces of one length
    are ranked by one task."""
    rows = written(pieces(docs, path, max_len, end_id, with_ids), "packing_pieces")
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    keys, shift, offset = solve(histogram, max_len).intervals()
    plan = docs.sparkSession.sparkContext.broadcast((keys, shift, offset))
    salts = F.element_at(F.array(*[F.lit(histogram.get(n, 0) // per_salt + 1) for n in range(1, max_len + 1)]), F.col("length").cast("int"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), salts))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = (salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "piece")) - 1)
              .join(starts, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("first")).drop("first", "salt", "row"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank", *(["ids"] if with_ids else [])]
    ranked = ranked.select(*names)
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())) if f.name == "ids" else f for f in ranked.schema.fields if f.name != "rank"]).add("sequence_id", "long").add("offset", "long")

    def place(batches):
        k, s, o = plan.value
        for b in slices(batches, "ids", 2 << 20) if with_ids else batches:
            if not b.num_rows:
                continue
            rank = b.column(5).to_numpy()
            at = np.searchsorted(k, (b.column(3).to_numpy() << 40) | rank, side="right") - 1
            cols = [b.column(i) for i in range(b.num_columns) if i != 5]
            if with_ids:
                cols[5], cols[4] = widen(cols[5], cols[3].to_numpy())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(rank + s[at]), pa.array(o[at])], names=schema.names)

    return ranked.mapInArrow(place, schema)
