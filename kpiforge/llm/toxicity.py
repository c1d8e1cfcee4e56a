"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag is labelled. A sentence
is toxic with probability sigmoid(bias + sum of its word weights); the
document is toxic unless all its sentences are clean (noisy-or). The
weights are fitted on the documents' labels alone, and then point at the
sentences that made a document toxic.

1. At most ``sample`` labelled documents (least by hash of the id, so
   always the same) take part in the fit; they are few enough to be found
   by a broadcast of their ids. That is the only bounded sample.
2. Features are words and word beginnings of 4 to 8 letters; those that
   are clearly more frequent in toxic documents (``vocabulary``, at most
   ``most`` of them) are counted distributedly over the sample.
3. Full-batch gradient steps on the noisy-or likelihood run on the driver
   over the sample's sentences that have a feature (others only count).
4. Every whole text is scored in one map with the broadcast weights.

Null and empty texts have no sentence; they score by the bias alone.
Without labelled documents of both kinds all weights are 0. Labels of an
id that repeats: the largest; repeated rows are scored each; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import id_crc, label_sample, slices, written

SAMPLE = 20_000
MOST = 8192
_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?\n]+")


def sentences(text: str) -> list[str]:
    return [s for s in _END.split(text) if s and not s.isspace()]


def features(word: str) -> list[str]:
    """The word itself (``word$``) and its beginnings of 4 to 8 letters."""
    return [word + "$", *(word[:n] for n in range(4, min(8, len(word)) + 1))]


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, text, toxic of the sampled labelled documents."""
    each = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    some = label_sample(each, ["doc_id"], "toxic", sample).select("doc_id", "toxic")
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")


def vocabulary(rows: DataFrame, most: int, least: int = 4) -> list[str]:
    """Features much more frequent in toxic documents, best first. The
    score is a z-value of the difference in document frequency."""
    def count(batches):
        seen: dict = {0: Counter(), 1: Counter()}

        def flush():
            keys = list(seen[0].keys() | seen[1].keys())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["feature", "pos", "neg"])
            seen[0].clear()
            seen[1].clear()

        for piece in slices(batches, "text", 4 << 20):
            for t, y in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                words = set(_WORD.findall((t or "").lower()))
                seen[int(y > 0)].update({f for w in words for f in features(w)})
                if len(seen[0]) + len(seen[1]) > 1 << 18:
                    yield from flush()
        yield from flush()

    counts = rows.select("text", "toxic").mapInArrow(count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n = {r["y"]: r["count"] for r in rows.groupBy((F.col("toxic") > 0).alias("y")).count().collect()}
    p, q = n.get(True, 0), n.get(False, 0)
    if not p or not q:
        return []
    a, b = F.col("pos") / p, F.col("neg") / q
    z = (a - b) / F.sqrt(a * (1 - a) / p + (F.col("neg") + 1) / (q + 1.0) / q)
    top = counts.filter((F.col("pos") >= least) & (a > 6 * b)).withColumn("z", F.round(z, 9)).filter("z > 3").orderBy(F.desc("z"), "feature").limit(most)
    return [r["feature"] for r in top.select("feature", "z").orderBy(F.desc("z"), "feature").collect()]


def bags(rows: DataFrame, vocab: list[str]) -> list[tuple[float, int, list[list[int]]]]:
    """(toxic, sentences without features, features of the others)."""
    known = rows.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(vocab)})

    def run(batches):
        get = known.value.get
        for piece in slices(batches, "text", 4 << 20):
            out = []
            for d, t, y in zip(*(piece.column(i).to_pylist() for i in range(3))):
                none, some = 0, []
                for s in sentences((t or "").lower()):
                    ids = sorted({i for w in _WORD.findall(s) for f in features(w) if (i := get(f)) is not None})
                    none += not ids
                    if ids:
                        some.append(ids)
                out.append((d, float(y > 0), none, some))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.list_(pa.int32()))))], names=["doc_id", "y", "none", "some"])

    got = rows.select(F.col("doc_id").cast("long"), "text", "toxic").mapInArrow(run, "doc_id long, y double, none long, some array<array<int>>").toArrow()
    got = sorted(got.to_pylist(), key=lambda r: (r["doc_id"], r["y"], r["none"], r["some"]))
    return [(r["y"], r["none"], r["some"]) for r in got]


def fit(data: list[tuple[float, int, list[list[int]]]], size: int, steps: int = 400, l2: float = 2e-5, rate: float = 0.1) -> tuple[float, np.ndarray]:
    """(bias, weights) of the noisy-or model by Adam on all bags."""
    bias, w = -4.0, np.zeros(size)
    if not size or not data:
        return bias, w
    y = np.array([d[0] for d in data])
    none = np.array([d[1] for d in data], float)
    bag = np.array([i for i, d in enumerate(data) for _ in d[2]], np.int64)
    ids = [s for d in data for s in d[2]]
    sent = np.repeat(np.arange(len(ids)), [len(s) for s in ids])
    flat = np.array([f for s in ids for f in s], np.int64)
    m = np.zeros(size + 1)
    v = np.zeros(size + 1)
    w += 0.5
    for t in range(1, steps + 1):
        x = bias + np.bincount(sent, w[flat], len(ids))
        clean = -np.logaddexp(0, x)                          # log(1 - p) of each sentence
        total = np.bincount(bag, clean, len(data)) - none * np.logaddexp(0, bias)
        total = np.minimum(total, -1e-12)
        # d loss / d log(1 - P): -(1 - y) + y (1 - P) / P
        g = -(1 - y) + y * np.exp(total) / -np.expm1(total)
        p = 1 / (1 + np.exp(-x))
        gs = g[bag] * -p
        grad = np.empty(size + 1)
        grad[:size] = np.bincount(flat, gs[sent], size) / len(data) + l2 * w
        grad[size] = (gs.sum() - (g * none).sum() / (1 + math.exp(-bias))) / len(data)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w = w - step[:size]
        bias -= float(step[size])
    return bias, w


class Scorer:
    """Sentence and document scores with frozen weights."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights, self.seen = bias, weights, {}

    def word(self, w: str) -> dict | None:
        """Features with weight of a word, None if there are none."""
        got = self.seen.get(w, 0)
        if got == 0:
            if len(self.seen) > 300_000:
                self.seen.clear()
            got = self.seen[w] = {f: x for f in features(w) if (x := self.weights.get(f)) is not None} or None
        return got

    def score(self, text: str) -> tuple[float, int, list[tuple[int, float, str]]]:
        """Document score, number of sentences, and (number, score, text)
        of the sentences that have weighted words."""
        low = text.lower()
        words = set(_WORD.findall(low))
        marked = [w for w in words if self.word(w)]
        parts = sentences(text)
        hit = []
        if marked:
            for i, s in enumerate(parts):
                found: dict = {}
                for w in _WORD.findall(s.lower()):
                    if f := self.seen.get(w) or self.word(w):
                        found.update(f)
                if found:
                    hit.append((i, 1 / (1 + math.exp(-max(-700.0, self.bias + sum(found[k] for k in sorted(found))))), s.strip()))
        log_clean = -(len(parts) - len(hit)) * math.log1p(math.exp(self.bias)) + sum(math.log(max(1e-300, 1 - p)) for _, p, _ in hit)
        return min(1.0, max(0.0, -math.expm1(log_clean))), len(parts), hit


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = MOST) -> tuple[float, dict[str, float]]:
    rows = written(training_rows(docs, labels, sample), "toxic_training")
    vocab = vocabulary(rows, most)
    bias, w = fit(bags(rows, vocab), len(vocab))
    return bias, dict(zip(vocab, w.tolist()))


def score(docs: DataFrame, model: tuple[float, dict[str, float]], threshold: float = 0.7, sentence_threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted, n_sentences and ``offending``: number,
    score and text of the sentences at or above sentence_threshold."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}
    kind = pa.list_(pa.struct([("number", pa.int64()), ("score", pa.float64()), ("text", pa.string())]))

    def run(batches):
        if "s" not in state:
            state["s"] = Scorer(*held.value)
        s = state["s"]
        for piece in slices(batches, "text", 4 << 20):
            out = []
            for d, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                p, n, hit = s.score(t or "")
                out.append((d, p, int(p >= threshold), n, [{"number": i, "score": x, "text": c} for i, x, c in hit if x >= sentence_threshold]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.float64(), pa.int32(), pa.int64(), kind))], names=["doc_id", "score", "predicted", "n_sentences", "offending"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int, n_sentences long, offending array<struct<number:long,score:double,text:string>>")


def held_out(mod: int = 3, held: int = 1):
    return id_crc() % mod == held
