"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.session import scratch_path

#: Null ids sort after every other id, so they are never "the smaller document".
NULL_ID = (1 << 63) - 1


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    Cuts the lineage, and gives later stages one copy of the rows that a
    lost executor cannot take away or change."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def label_sample(rows: DataFrame, keys: list[str], label: str, sample: int) -> DataFrame:
    """At most ``sample`` distinct (keys, label), with ``weight``: the rows
    each stands for.

    Both kinds of label (0 and 1) have room for half of the sample, and
    what one leaves is the other's, so rare labels are not lost among
    frequent ones; copies are one row. Chosen by least hash. The weights of
    a kind sum up to its rows in ``rows``."""
    each = written(rows.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("weight")).withColumn("__h", F.xxhash64(*keys)), "label_rows")
    n = {int(r[label]): r["n"] for r in each.groupBy(label).agg(F.count("*").alias("n")).collect()}
    most1 = min(n.get(1, 0), max(sample // 2, sample - n.get(0, 0)))
    some = [each.filter(F.col(label) == y).orderBy("__h", *keys).limit(m) for y, m in ((0, sample - most1), (1, most1))]
    some = written(some[0].unionByName(some[1]), "label_sample")
    total, taken = ({int(r[label]): r["w"] for r in d.groupBy(label).agg(F.sum("weight").alias("w")).collect()} for d in (each, some))
    scale = F.when(F.col(label) == 1, total.get(1, 0) / max(taken.get(1, 0), 1)).otherwise(total.get(0, 0) / max(taken.get(0, 0), 1))
    return some.withColumn("weight", F.col("weight") * scale).drop("__h")


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id as text (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one array, and its n + 1 offsets.

    Nulls are empty texts. No per-row Python objects are made."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


@functools.cache
def _trim():
    """glibc's malloc_trim, where there is one."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def give_back() -> None:
    """Returns freed memory to the system. Workers live through many tasks
    and stages; without this, what one stage held stays theirs in the next.
    Objects that refer to each other are freed first: a few of them may hold
    large tables, which the collector, counting objects, does not see."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches, column: str, max_bytes: int):
    """Cut record batches into pieces whose text column holds at most about
    ``max_bytes`` (a longer single text is a piece of its own)."""
    give_back()                                   # what the worker's last task left
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_buffers(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(off, off[start] + max_bytes, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
    give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: spreads keys over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def byte_table(seed: int) -> np.ndarray:
    """One random-looking 64-bit word for each byte value."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if len(_powers.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                p = np.full(n, np.uint64(b))
                p[0] = 1
                _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


_BYTE = byte_table(17)


def word_hashes(data: np.ndarray, off: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the number of its text. ``word``
    marks the bytes of words; a word never crosses a text's end."""
    if not len(data) or not word.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start = word.copy()
    start[1:] &= ~word[:-1]
    inner = off[1:-1][off[1:-1] < len(data)]
    start[inner] |= word[inner]
    first = np.flatnonzero(start)
    gap = np.flatnonzero(~word)
    end = np.concatenate((first[1:], [len(data)]))
    if len(gap):
        at = np.searchsorted(gap, first)
        end = np.minimum(end, np.where(at < len(gap), gap[np.minimum(at, len(gap) - 1)], len(data)))
    up, down = power_tables(len(data))
    with np.errstate(over="ignore"):
        total = np.cumsum(_BYTE[data] * up, dtype=np.uint64)
        total = np.concatenate((np.zeros(1, np.uint64), total))
        h = mix64((total[end] - total[first]) * down[first])
    return h, np.searchsorted(off, first, side="right") - 1


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
