"""Vector codes by integer Walsh-Hadamard search.

Every vector is cut into ``parts`` equal consecutive parts of integers
floor(scale * x), and each part is replaced by the index of its nearest
codebook entry. Codebooks start as the parts of the first ``entries``
vectors by id and are replaced ``rounds`` times by the floor of the mean
of the parts assigned to them.

The search is exact and has no floating point: parts and entries are
padded with zeros to a power of two P and go through an integer
Walsh-Hadamard transform, under which squared distances grow by the factor
P exactly. Coefficients are taken in order of sequency, so the slow
changes, which hold most of the distance, come first. Every partial sum is
a lower bound of P times the distance; an entry goes as soon as it is
above the distance of the best entry so far (all of the entry that leads
after the first coefficients). Ties go to the lower index.

On Spark: each round is one map over the vectors, which sends one row of
sums for each used entry of each task, added up by Spark; codebooks
(``parts * entries`` rows, whatever the input) are all that reaches the
driver and all that is broadcast.

Vectors that are null or hold nulls or non-finite numbers are dropped.
Null ids come last among the starting vectors, equal ids are ordered by
their vectors; repeated rows count each. Shorter vectors are padded with
zeros to the longest, and that to a multiple of ``parts``; empty vectors
have error 0. With fewer vectors than ``entries`` the codebooks are
smaller. An empty table gives no rows. Components so large that a distance
could leave 64 bits (beyond about 90,000 at 64 dimensions) raise an error.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK = 1024          # vectors compared at a time


# ---- integer transform and search ---------------------------------------------

def sequency(p: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix of order ``p`` by number of sign
    changes: the bit-reversed Gray code of 0 .. p - 1."""
    s = np.arange(p)
    gray = s ^ (s >> 1)
    out = np.zeros(p, np.int64)
    for _ in range(p.bit_length() - 1):
        out = (out << 1) | (gray & 1)
        gray >>= 1
    return out


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows of ``x`` (int64), zero-padded to
    a power of two, in order of sequency."""
    n, width = x.shape
    p = 1 << max(0, width - 1).bit_length()
    y = np.zeros((n, p), np.int64)
    y[:, :width] = x
    step = 1
    while step < p:
        y = y.reshape(n, p // (2 * step), 2, step)
        y = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, p)
        step *= 2
    return y[:, sequency(p)]


def limit(width: int) -> int:
    """Largest magnitude of a component at which no sum leaves 64 bits."""
    p = 1 << max(0, width - 1).bit_length()
    return math.isqrt((1 << 61) // (p * p))


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry and the squared distance, for transformed
    rows and entries; and how many coefficients were compared."""
    n, p = rows.shape
    head = max(1, p // 8)
    partial = np.zeros((n, len(book)), np.int64)
    for j in range(head):
        partial += np.square(rows[:, j, None] - book[None, :, j])
    best = np.square(rows - book[partial.argmin(1)]).sum(1)
    row, entry = np.nonzero(partial <= best[:, None])
    total = partial[row, entry]
    work = n * len(book) * head
    step = head
    while step < p:
        to = min(p, 2 * step)
        total = total + np.square(rows[row, step:to] - book[entry, step:to]).sum(1)
        work += len(row) * (to - step)
        stay = total <= best[row]
        row, entry, total = row[stay], entry[stay], total[stay]
        step = to
    # Pairs are in order of row and entry, and each row has at least one left.
    first = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(total, first) if n else total
    hit = np.flatnonzero(total == least[row])
    index = entry[hit[np.searchsorted(row[hit], np.arange(n))]]
    return index, least // p, work


@dataclass
class Codebooks:
    """``books``: for each part, its entries as integers (k x width)."""

    books: list[np.ndarray]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes (n x parts) and squared distances (n x parts)."""
        n = len(vectors)
        width = self.books[0].shape[1]
        code, error = np.zeros((n, len(self.books)), np.int64), np.zeros((n, len(self.books)), np.int64)
        if not width:
            return code, error
        for p, book in enumerate(self.books):
            entries = transform(book)
            for a in range(0, n, BLOCK):
                part = transform(vectors[a:a + BLOCK, p * width:(p + 1) * width])
                code[a:a + BLOCK, p], error[a:a + BLOCK, p], _ = nearest(part, entries)
        return code, error

    def digest(self) -> str:
        numbers = ",".join(str(v) for book in self.books for entry in book.tolist() for v in entry)
        return hashlib.sha256(numbers.encode()).hexdigest()


# ---- Spark operator ------------------------------------------------------------

def integers(column: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of a list column, zero-padded to ``width``."""
    n = len(column)
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    most = limit(width // PARTS if width >= PARTS else 1)
    if len(flat) and np.abs(flat).max() > most:
        raise ValueError(f"a vector component is beyond {most / scale:g}: squared distances would not fit 64 bits")
    out = np.zeros((n, width), np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    out[np.repeat(np.arange(n), counts), place] = flat.astype(np.int64)
    return out


def usable(vector: str) -> Column:
    """Neither null nor holding a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def _sums(kept: DataFrame, books: Codebooks, width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """For each used entry (part, index): how many parts it has, and their
    componentwise sum."""
    shared = kept.sparkSession.sparkContext.broadcast(books)
    size = books.books[0].shape[1]

    def partial(batches):
        n = [np.zeros(len(b), np.int64) for b in shared.value.books]
        total = [np.zeros(b.shape, np.int64) for b in shared.value.books]
        for batch in batches:
            v = integers(batch.column(0), width)
            code, _ = shared.value.assign(v)
            for p in range(len(n)):
                np.add.at(n[p], code[:, p], 1)
                np.add.at(total[p], code[:, p], v[:, p * size:(p + 1) * size])
        rows = [(p, int(e), int(n[p][e]), total[p][e].tolist()) for p in range(len(n)) for e in np.flatnonzero(n[p])]
        if rows:
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["part", "entry", "n", "total"])

    rows = kept.select("vector").mapInArrow(partial, "part int, entry int, n long, total array<long>")
    added = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"c{i}") for i in range(size)])
    return {(r["part"], r["entry"]): (r["n"], [r[f"c{i}"] for i in range(size)]) for r in added.collect()}


def fit(kept: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, int] | None:
    """Codebooks of ``kept`` (vec_id, vector) and the padded number of
    dimensions; None without vectors. At most ``parts * entries`` rows reach
    the driver."""
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return None
    width = -(-longest // PARTS) * PARTS
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()["vector"].combine_chunks()
    vectors = integers(start.chunk(0) if isinstance(start, pa.ChunkedArray) else start, width)
    size = width // PARTS
    books = Codebooks([vectors[:, p * size:(p + 1) * size].copy() for p in range(PARTS)])
    for _ in range(rounds if size else 0):
        for (p, e), (n, total) in _sums(kept, books, width).items():
            books.books[p][e] = [t // n for t in total]
    return books, width


def encode(table: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, indexes, errors) of every usable vector, written once,
    and the codebooks: ``indexes`` and ``errors`` are arrays by part."""
    kept = table.filter(usable(vector)).select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    fitted = fit(kept, entries, rounds)
    books, width = fitted or (Codebooks([np.zeros((0, 0), np.int64)] * PARTS), 0)
    shared = table.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            code, error = shared.value.assign(integers(b.column(2), width))
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * PARTS)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (code, error)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["vec_id", "label", "indexes", "errors"])

    kinds = dict(kept.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, indexes array<long>, errors array<long>"
    return written(kept.select("vec_id", "label", "vector").mapInArrow(run, schema), "vector_codes"), books


def codes(table: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error,
    codebooks_sha256."""
    coded, books = encode(table, vector, key, label)
    rows = coded.select("vec_id", "label", F.lower(F.array_join(F.transform("indexes", lambda i: F.lpad(F.hex(i), 2, "0")), "")).alias("code"),
                        F.aggregate("errors", F.lit(0).cast("long"), lambda a, e: a + e).alias("error"))
    by_label = written(rows.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")), "vector_label_errors")
    return rows.join(by_label, rows["label"].eqNullSafe(by_label["__label"])).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
