"""Quality rules with robust multivariate outliers.

Seven statistics of a whole text are made comparable by transforms and
shrinkage (``FEATURES``); per language and source the minimum covariance
determinant (MCD) estimate gives the centre and shape of the bulk of the
documents, and a document whose squared Mahalanobis distance passes
``limit`` is rejected.

MCD on Spark: start from the coordinate-wise median and quartile range,
then repeat concentration steps: distance of every document to its
group's estimate, exact ``h``-quantile of the (rounded) distances in each
group, and the mean and covariance of the documents within it. Each step
is two partially aggregated groupings, so a source with a third of all
documents only sends sums. The estimates use all documents of a group.
Groups below ``min_group`` documents share their language's estimate, and
languages below it the global one. Statistics that hardly vary among
good documents get a variance floor (``FLOORS``), so a degenerate
covariance cannot reject on noise.

Nulls and empty texts have zero words; null languages or sources are
groups of their own; repeated rows are judged each.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import slices, text_buffers, word_hashes, written

FEATURES = ["f_len", "f_sym", "f_dup", "f_rep", "f_caps", "f_punct", "f_adj"]
#: Standard deviations below which a feature's spread is taken as noise.
FLOORS = [0.03, 0.05, 0.15, 0.15, 0.05, 0.05, 0.05]
#: Squared Mahalanobis distance beyond which a document is an outlier.
LIMIT = 40.0
#: Median of chi-square with seven degrees of freedom: scales the covariance of the kept half.
CHI2_MEDIAN = 6.346

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True

STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper long, n_punct long, n_adjacent long"


def repeat_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in windows of ``size`` words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(size))))
    seen = Counter(windows)
    hit = np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(windows):
        if seen[w] > 1:
            hit[i] += 1
            hit[min(i + size, len(words))] -= 1
    return int((np.cumsum(hit[:-1]) > 0).sum())


def text_stats(column: pa.Array, size: int = 5) -> dict[str, np.ndarray]:
    """The statistics of each text of a string column."""
    data, off = text_buffers(column)
    n = len(off) - 1

    def per_text(mask):
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[off[1:]] - total[off[:-1]]

    space = _SPACE[data]
    hashes, doc = word_hashes(data, off, ~space)
    n_words = np.bincount(doc, minlength=n).astype(np.int64)
    out = {
        "n_words": n_words,
        "word_chars": per_text(~space & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(_SYMBOL[data]),
        "n_lines": np.zeros(n, np.int64), "n_dup_lines": np.zeros(n, np.int64), "n_repeat_words": np.zeros(n, np.int64),
        "n_upper": per_text(_UPPER[data]), "n_punct": per_text(_PUNCT[data]),
        "n_adjacent": np.bincount(doc[1:][(hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])], minlength=n).astype(np.int64),
    }
    # Texts in which some window hash occurs twice are counted exactly below.
    again = np.zeros(n, bool)
    if len(hashes) >= size:
        with np.errstate(over="ignore"):
            win = hashes[:len(hashes) - size + 1].copy()
            for j in range(1, size):
                win = win * np.uint64(0x9E3779B97F4A7C15) + hashes[j:len(hashes) - size + 1 + j]
        inside = doc[:len(win)] == doc[size - 1:]
        win, where = win[inside], doc[:len(inside)][inside]
        with np.errstate(over="ignore"):
            order = np.argsort(win + (where.astype(np.uint64) << np.uint64(40)) * np.uint64(0xD6E8FEB86659FD93), kind="stable")
        same = (win[order][1:] == win[order][:-1]) & (where[order][1:] == where[order][:-1])
        again[where[order][1:][same]] = True
    raw = data.tobytes()
    for i in range(n):
        text = raw[off[i]:off[i + 1]]
        lines = [x for x in text.split(b"\n") if x.strip()]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        if again[i]:
            out["n_repeat_words"][i] = repeat_words(text.split(), size)
    return out


def with_stats(docs: DataFrame, extra: list[str], text: str = "text") -> DataFrame:
    """``extra`` columns of docs, then the statistics of ``text``."""
    fields = docs.select(*extra).schema

    def run(batches):
        for piece in slices(batches, text, 1 << 20):
            st = text_stats(piece.column(piece.schema.get_field_index(text)))
            cols = [piece.column(piece.schema.get_field_index(c)) for c in extra]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(v, pa.int64()) for v in st.values())], names=[*extra, *st])

    for x in STATS.split(", "):
        name, kind = x.split()
        fields = fields.add(name, kind)
    return docs.select(*dict.fromkeys([*extra, text])).mapInArrow(run, fields)


def transformed(stats: DataFrame) -> DataFrame:
    """Adds FEATURES. Ratios are shrunk towards a clean text's by some
    virtual words, so that short texts do not scatter, and square roots
    even out the spread of counts."""
    c = F.col
    words, chars = c("n_words") + 30, c("word_chars") + 180
    return stats.withColumns({
        "f_len": F.log(chars / words),
        "f_sym": F.sqrt(c("n_symbols") / chars),
        "f_dup": F.sqrt(c("n_dup_lines") / (c("n_lines") + 3)),
        "f_rep": F.sqrt(c("n_repeat_words") / words),
        "f_caps": F.sqrt(c("n_upper") / chars),
        "f_punct": F.sqrt(c("n_punct") / chars),
        "f_adj": F.sqrt(c("n_adjacent") / words),
    })


#: Up to so many groups (about 0.6 kB each) their estimates are broadcast; beyond, joins are salted.
BROADCAST_GROUPS = 20_000
SALTS = 64


def _with(rows: DataFrame, per_group: DataFrame, few: bool, on: str = "grp") -> DataFrame:
    """rows joined with one row of each group, without bringing a group's
    rows together in one task."""
    if few:
        return rows.join(F.broadcast(per_group), on)
    salted = per_group.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*FEATURES), F.lit(SALTS)).cast("int")).join(salted, [on, "__salt"]).drop("__salt")


def _distance():
    """Squared Mahalanobis distance to the joined estimate (``centre``,
    ``inverse`` row by row)."""
    p = len(FEATURES)
    d = [F.col(f) - F.col("centre")[i] for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            total = total + d[i] * d[j] * F.col("inverse")[i * p + j] * (1.0 if i == j else 2.0)
    return total


def _d2(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The features of a batch of rows joined with their estimates, and
    log(1 + squared distance), rounded."""
    p = len(FEATURES)
    col = lambda c: b.column(b.schema.get_field_index(c))
    x = np.stack([col(f).to_numpy() for f in FEATURES], 1)
    d = x - col("centre").flatten().to_numpy().reshape(-1, p)
    d2 = np.einsum("ni,nij,nj->n", d, col("inverse").flatten().to_numpy().reshape(-1, p, p), d)
    return x, np.round(np.log1p(np.maximum(d2, 0)), 3)


def _measured(rows: DataFrame) -> DataFrame:
    """grp and d2 of rows joined with their estimates."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_d2(b)[1])], names=["grp", "d2"])

    return rows.select("grp", *FEATURES, "centre", "inverse").mapInArrow(run, "grp string, d2 double")


def _estimates(rows: DataFrame) -> DataFrame:
    """grp, centre, inverse covariance of the rows within ``cut`` of the
    estimates they are joined with. Each batch sends its sums by group: one
    row for each moment.

    One map measures and sums: two in a row would take two Python workers
    for each task, which Spark then keeps for all later stages."""
    p = len(FEATURES)
    upper = np.triu_indices(p)

    def sums(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, d2 = _d2(b)
            near = d2 <= b.column(b.schema.get_field_index("cut")).to_numpy()
            if not near.any():
                continue
            x, grp = x[near], b.column(0).filter(pa.array(near)).dictionary_encode()
            full = np.concatenate([np.ones((len(x), 1)), x, x[:, upper[0]] * x[:, upper[1]]], 1)
            code, names = grp.indices.to_numpy(), grp.dictionary.to_pylist()
            total = np.stack([np.bincount(code, full[:, j], len(names)) for j in range(full.shape[1])], 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, object), full.shape[1]), pa.string()), pa.array(np.tile(np.arange(full.shape[1]), len(names))), pa.array(total.ravel())], names=["grp", "i", "v"])

    def invert(batches):
        for b in batches:
            centre, inverse = [], []
            for m in b.column(1).to_pylist():
                v = np.array([x["v"] for x in sorted(m, key=lambda x: x["i"])])
                mean, cov = v[1:p + 1] / v[0], np.empty((p, p))
                cov[upper] = v[p + 1:] / v[0]
                cov.T[upper] = cov[upper]
                cov += np.diag(np.square(FLOORS)) - np.outer(mean, mean)
                centre.append(mean.tolist())
                inverse.append(np.linalg.inv(cov).ravel().tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(centre, pa.list_(pa.float64())), pa.array(inverse, pa.list_(pa.float64()))], names=["grp", "centre", "inverse"])

    moments = rows.select("grp", *FEATURES, "centre", "inverse", "cut").mapInArrow(sums, "grp string, i long, v double").groupBy("grp", "i").agg(F.sum("v").alias("v"))
    return moments.groupBy("grp").agg(F.collect_list(F.struct("i", "v")).alias("m")).mapInArrow(invert, "grp string, centre array<double>, inverse array<double>")


def mcd(rows: DataFrame, few: bool, h: float = 0.75, steps: int = 4) -> DataFrame:
    """grp, centre, inverse, scale: the MCD estimate of each ``grp`` of
    rows (columns grp and FEATURES). ``few``: groups fit a broadcast."""
    p = len(FEATURES)
    quart = rows.groupBy("grp").agg(*[F.percentile(F.round(f, 3), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p{i}") for i, f in enumerate(FEATURES)])
    zero = F.lit(0.0)
    est = quart.select(
        "grp", F.array(*[F.col(f"p{i}")[1] for i in range(p)]).alias("centre"),
        F.array(*[F.lit(1.0) / F.pow(F.greatest((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, F.lit(FLOORS[i])), F.lit(2.0)) if i == j else zero for i in range(p) for j in range(p)]).alias("inverse"))
    for _ in range(steps):
        est = written(est, "mcd_estimate")
        held = _with(rows, est, few)
        cut = _measured(held).groupBy("grp").agg(F.percentile("d2", h).alias("cut"))
        est = _estimates(_with(held, cut, few))
    est = written(est, "mcd_estimate")
    half = _measured(_with(rows, est, few)).groupBy("grp").agg(F.expm1(F.percentile("d2", 0.5)).alias("half"))
    # Floors already widen the covariance, so it is never shrunk.
    return written(est.join(half, "grp").select("grp", "centre", "inverse", F.greatest(F.col("half") / CHI2_MEDIAN, F.lit(1.0)).alias("scale")), "mcd")


def _rows(docs: DataFrame, extra: list[str], pre: str = "") -> DataFrame:
    """Statistics, features, base verdict and group keys of each document,
    from columns whose names begin with ``pre``."""
    rows = transformed(with_stats(docs, [*dict.fromkeys([*extra, f"{pre}lang", f"{pre}source"])], f"{pre}text"))
    lang, source = F.coalesce(F.col(f"{pre}lang"), F.lit("")), F.coalesce(F.col(f"{pre}source"), F.lit(""))
    return rows.withColumns({
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "own": F.concat_ws("\u0001", lang, source), "own_lang": lang})


def estimates(rows: DataFrame, min_group: int, h: float, steps: int) -> tuple[DataFrame, bool]:
    """own, grp, centre, inverse, scale: the estimate that judges the
    documents of each language and source; and whether they are few."""
    # The finest level with enough documents: language and source, language, all.
    sizes = written(rows.groupBy("own_lang", "own").agg(F.count("*").alias("n")), "quality_groups")
    by_lang = sizes.groupBy("own_lang").agg(F.sum("n").alias("m"))
    level = (F.when(F.col("n") >= min_group, F.concat(F.lit("s:"), "own"))
             .when(F.col("m") >= min_group, F.concat(F.lit("l:"), "own_lang")).otherwise("all"))
    groups = written(sizes.join(by_lang, "own_lang").select("own_lang", "own", level.alias("grp")), "quality_levels")
    few = groups.count() <= BROADCAST_GROUPS
    rows = _with(rows, groups.drop("own_lang"), few, "own")
    # A language's estimate is learnt from all its documents, the global one from all.
    needed = groups.filter("grp LIKE 'l:%'").select("own_lang", F.col("grp").alias("to")).distinct()
    of_lang = rows.filter("grp LIKE 's:%'").join(needed, "own_lang").select(F.col("to").alias("grp"), *FEATURES)
    parts = rows.select("grp", *FEATURES).unionByName(of_lang)
    if not groups.filter("grp = 'all'").isEmpty():
        parts = parts.unionByName(rows.filter("grp <> 'all'").select(F.lit("all").alias("grp"), *FEATURES))
    # Every step reads the rows twice: written once, the steps' plans are a scan
    # instead of the joins and branches above, over and over.
    parts = written(parts, "mcd_rows")
    return groups.drop("own_lang").join(mcd(parts, few, h, steps), "grp"), few


def _verdict(rows: DataFrame, est: tuple[DataFrame, bool], limit: float) -> DataFrame:
    out = _with(rows, *est, on="own").withColumn("distance", F.greatest(_distance(), F.lit(0.0)) / F.col("scale"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= limit))


def judge(docs: DataFrame, min_group: int = 200, h: float = 0.75, steps: int = 4, limit: float = LIMIT, extra: list[str] | None = None) -> DataFrame:
    """doc_id (and ``extra``), the statistics, base_failed, kept, distance
    (squared, scaled) and the name of the estimate used."""
    keep = ["doc_id", *(extra or [])]
    rows = written(_rows(docs, keep), "quality_rows")
    out = _verdict(rows, estimates(rows, min_group, h, steps), limit)
    stats = [x.split()[0] for x in STATS.split(", ")]
    return out.select(*keep, *stats, "base_failed", "kept", "distance", F.col("grp").alias("estimate"))


def kept(docs: DataFrame, min_group: int = 200, h: float = 0.75, steps: int = 4, limit: float = LIMIT) -> DataFrame:
    """The rows of docs that :func:`judge` keeps. Texts are read twice
    (statistics, then verdicts beside the text) instead of shuffled."""
    rows = written(_rows(docs, []).select("own_lang", "own", *FEATURES), "quality_rows")
    est = estimates(rows, min_group, h, steps)
    names = docs.columns
    own = docs.select(*[F.col(c).alias(f"__{c}") for c in names])
    return _verdict(_rows(own, own.columns, "__"), est, limit).filter("kept").select(*[F.col(f"__{c}").alias(c) for c in names])
