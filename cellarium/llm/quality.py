"""Quality classifier: Naive Bayes support vectors.

Indicators of hashed n-grams (words, word pairs, and shapes of words with their pairs) are scaled
by the log-count ratios of the two classes and brought to unit length; a linear hinge-loss model is
fitted to them by dual coordinate descent. Margins of rows left out of a fit are mapped to
probabilities by a logistic curve. The fit uses at most SAMPLE labelled rows of each class, drawn
by the hash of their doc_id; every text is scored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

WIDTH = 1 << 20
#: Labelled rows of each class that the model is fitted to, at most.
SAMPLE = 5_000
THRESHOLD = 0.7
C = 1.0
EPOCHS = 12
_SHAPE = bytes(
    120 if 97 <= b <= 122 or b >= 128 else 88 if 65 <= b <= 90 else 100 if 48 <= b <= 57 else b for b in range(256)
)
_SAME = re.compile(rb"(.)\1+", re.DOTALL)


class Words(dict):
    """Word to hashes of its lower-case form and of its shape (runs of like characters as one)."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        shape = _SAME.sub(rb"\1", word.translate(_SHAPE))
        got = (xxhash.xxh3_64_intdigest(word.lower()), xxhash.xxh3_64_intdigest(shape, 1))
        if len(self) < 500_000:
            self[word] = got
        return got


def features(text: bytes, words: Words) -> np.ndarray:
    """Sorted places of the n-grams that the text holds."""
    split = text.split()
    if not split:
        return np.empty(0, np.int32)
    h = np.array([words[w] for w in split], np.uint64)
    low, shape = h[:, 0], h[:, 1]
    mul = np.uint64(0x9E3779B97F4A7C15)
    pair = (low[:-1] * mul) ^ (low[1:] + np.uint64(3))
    pair = np.where(low[:-1] == low[1:], np.uint64(77), pair)  # a word said twice running
    shapes = (shape[:-1] * mul) ^ (shape[1:] + np.uint64(5))
    every = np.concatenate([low, shape, pair, shapes])
    every = ((every ^ (every >> np.uint64(29))) * mul) >> np.uint64(44)
    return np.unique(every.astype(np.int32))


class Model:
    """ratio: log-count ratios; weight: of the scaled indicators; margin to probability by a, b."""

    def __init__(self, weight: np.ndarray, ratio: np.ndarray, bias: float, a: float, b: float):
        self.weight, self.ratio, self.bias, self.a, self.b = weight, ratio, bias, a, b

    def margin(self, places: np.ndarray) -> float:
        r = self.ratio[places].astype(np.float64)
        return float(r @ self.weight[places]) / (math.sqrt(float(r @ r)) or 1.0) + self.bias

    def score(self, places: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.a * self.margin(places) + self.b))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.ones((2, WIDTH))
    for y, r in zip(labels, rows):
        counts[int(y), r] += 1
    counts /= counts.sum(1, keepdims=True)
    return np.log(counts[1] / counts[0]).astype(np.float32)


def hinge_fit(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = C, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """min 1/2 |w|^2 + cost * sum of class-balanced hinge losses, by dual coordinate descent.

    For row i with y_i = +-1 the dual variable moves to clip(alpha - G / Q, 0, U_i), where
    G = y_i (w . x_i) - 1 and Q = |x_i|^2 (one, plus one for the bias).
    """
    w, bias = np.zeros(WIDTH), 0.0
    y = np.where(labels == 1, 1.0, -1.0)
    upper = cost * np.where(y > 0, 0.5 * len(y) / max(1, (y > 0).sum()), 0.5 * len(y) / max(1, (y < 0).sum()))
    xs = []
    for r in rows:
        x = ratio[r].astype(np.float64)
        xs.append((x / (np.linalg.norm(x) or 1.0)).astype(np.float32))
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, r = xs[i], rows[i]
            g = y[i] * (float(w[r] @ x) + bias) - 1
            q = 2.0 if len(r) else 1.0
            new = min(max(alpha[i] - g / q, 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * x
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def _curve(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Logistic curve over margins, by Newton steps with a slight pull to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - labels) * weights * margins).sum() + 1e-2 * (a - 1), ((p - labels) * weights).sum() + 1e-2 * b])
        s = p * (1 - p) * weights
        h = np.array([[(s * margins**2).sum() + 1e-2, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def fit(rows: list[np.ndarray], labels: np.ndarray, prior: float) -> Model:
    """``prior``: the share of label 1 among all labelled rows, of which ``rows`` is a sample."""
    labels = np.asarray(labels)
    if len(set(labels.tolist())) < 2:
        p = min(max(prior, 1e-3), 1 - 1e-3)
        return Model(np.zeros(WIDTH, np.float32), np.zeros(WIDTH, np.float32), 0.0, 1.0, math.log(p / (1 - p)))
    margins = np.zeros(len(rows))
    fold = np.arange(len(rows)) % 2
    for f in (0, 1):
        use = np.flatnonzero(fold != f)
        if len(set(labels[use].tolist())) < 2:
            use = np.arange(len(rows))
        r = log_count_ratios([rows[i] for i in use], labels[use])
        w, bias = hinge_fit([rows[i] for i in use], labels[use], r)
        m = Model(w, r, bias, 1.0, 0.0)
        for i in np.flatnonzero(fold == f):
            margins[i] = m.margin(rows[i])
    share = labels.mean()
    weights = np.where(labels == 1, prior / share, (1 - prior) / (1 - share))
    ratio = log_count_ratios(rows, labels)
    w, bias = hinge_fit(rows, labels, ratio)
    return Model(w.astype(np.float32), ratio, bias, *_curve(margins, labels, weights))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        places = [features(t, words).tobytes() for t in batch.column("raw").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(places, pa.binary())], ["doc_id", "quality", "places"])


def held_out(doc_id: str = "doc_id"):
    """Rows that labels are never learnt from: crc32 of the doc_id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit to at most ``sample`` rows of each class that are not held out.

    A doc_id with several labels has the least; null labels and doc_ids are left out.
    """
    tune(docs.sparkSession)
    known = (
        labels.filter("doc_id is not null and quality is not null").filter(~held_out())
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    )
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    drawn = [known.filter(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    some = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")).join(
        F.broadcast(drawn[0].union(drawn[1])), "doc_id"  # at most 2 * sample rows of two numbers
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = some.mapInArrow(_featured, f"doc_id {kind}, quality int, places binary")
    # rows that repeat a doc_id are drawn once, so the sample keeps its bound
    got = got.groupBy("doc_id").agg(F.min(F.struct("quality", "places")).alias("x")).select("x.*", "doc_id")
    rows = sorted(got.collect(), key=lambda r: xxhash.xxh3_64_intdigest(str(r["doc_id"])))
    return fit([np.frombuffer(r["places"], np.int32) for r in rows], np.array([r["quality"] for r in rows]), prior)


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(row, score, predicted) for every row of ``docs``; ``row`` holds all its columns.

    Null and empty texts have no n-grams and score what the bias gives. No rows: no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)  # WIDTH numbers of 4 bytes, twice

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = Words(), shared.value
        for batch in batches:
            scores = np.array([own.score(features(t, words)) for t in batch.column("raw").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))],
                ["row", "score", "predicted"],
            )

    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    return rows.mapInArrow(scored, f"row {rows.schema['row'].dataType.simpleString()}, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labels`` (doc_id, quality) and score all of ``docs``."""
    return classify(docs, train(docs, labels))
