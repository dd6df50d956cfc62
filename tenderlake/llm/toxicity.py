"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document has an n-gram (ORDERS characters, BINS bins) or hasn't. For each n-gram, the log ratio of
its share among toxic and among other labelled documents scales its feature; n-grams in fewer than
MIN_DOCS of them, or with a ratio near 0, are left out. A logistic regression is fitted on the
scaled features. Ratios and weights are learned from at most POSITIVE toxic and NEGATIVE other
documents, the first ones by a hash of doc_id; of rows that share a doc_id, from one text, the first by
a hash. What is broadcast or gathered by the driver is
bounded by these numbers and BINS.

A null or empty text has no feature and gets the score of the intercept. Labels that are null aren't
read; of labels that repeat a doc_id, the largest counts. Without both classes every score is 0.
Rows that repeat are scored alike; columns of docs other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._ngrams import chunks, codes, dense_counts
from ._worker import parts

ORDERS = (4, 5)
BINS = 1 << 19
POSITIVE, NEGATIVE = 6_000, 12_000
MIN_DOCS = 4
LEAST_RATIO = 1.0


@dataclass
class Model:
    weights: np.ndarray  # of BINS + 1 bins: regression weight times log-count ratio, 0 for what is left out
    intercept: float


def _present(texts: list[str | None], used: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The distinct bins of each text, of those marked in used."""
    for _, points, edges in chunks(texts):
        each = [codes(points, edges, order, BINS) for order in ORDERS]
        if used is None:
            for a, b in zip(edges[:-1], edges[1:]):
                found = np.unique(np.concatenate([x[a:b] for x in each]))
                yield found[found < BINS]
        else:
            row, code = [], []
            for x in each:
                at = np.flatnonzero(used[x])
                row.append(np.searchsorted(edges, at, "right") - 1)
                code.append(x[at])
            pair = np.unique(np.concatenate(row).astype(np.int64) * (BINS + 1) + np.concatenate(code))
            yield from np.split(pair % (BINS + 1), np.searchsorted(pair // (BINS + 1), np.arange(1, len(edges) - 1)))


def _count(batch: pa.RecordBatch, totals: dict[str, np.ndarray]) -> None:
    texts, labels = (c.to_pylist() for c in batch.columns)
    for found, label in zip(_present(texts), labels):
        totals[str(label)][found] += 1


def _collect(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [x.astype(np.int32).tobytes() for x in _present(batch.column(0).to_pylist(), sent.value)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["bins", "label"])

    return run


def _fit(features: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, weight: np.ndarray, steps: int = 1000, penalty: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by accelerated gradient descent; features are bins, scale their values."""
    used, flat = np.unique(np.concatenate([*features, np.zeros(0, np.int32)]), return_inverse=True)
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    value = scale[used][flat]
    w, b = np.zeros(len(used)), 0.0
    v, vb = w.copy(), b
    norm = np.bincount(row, value**2, len(features)).max(initial=1.0)
    rate = 4.0 / (norm + 1)
    for t in range(steps):
        z = np.bincount(row, value * v[flat], len(features)) + vb
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        w2 = v - rate * (np.bincount(flat, value * error[row], len(used)) + penalty * v)
        b2 = vb - rate * error.sum()
        k = t / (t + 3)
        v, vb = w2 + k * (w2 - w), b2 + k * (b2 - b)
        w, b = w2, b2
    out = np.zeros(BINS + 1)
    out[used] = w * scale[used]
    return out, float(b)


def train(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic): labels of the documents to learn from."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    first = lambda label, n: known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    # positive + negative rows at most
    drawn = docs.select("doc_id", "text").join(F.broadcast(first(1, positive).union(first(0, negative))), "doc_id")
    sample = drawn.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label")).select("text", "label")
    counts = dense_counts(sample, ["0", "1"], _count, BINS)
    n = [sample.where(F.col("label") == k).count() for k in (0, 1)]
    if not all(n):
        return Model(np.zeros(BINS + 1, np.float32), -np.inf)
    p, q = (counts["1"] + 1) / (n[1] + 2), (counts["0"] + 1) / (n[0] + 2)
    ratio = np.log(p / q)
    ratio[(counts["0"] + counts["1"] < MIN_DOCS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    scale = np.append(ratio, 0.0)
    sent = spark.sparkContext.broadcast(scale != 0)
    rows = sample.mapInArrow(_collect(sent), "bins binary, label int").collect()
    y = np.array([r["label"] for r in rows], float)
    weights, intercept = _fit([np.frombuffer(r["bins"], np.int32) for r in rows], y, scale, np.full(len(y), 1 / len(y)))
    return Model(weights.astype(np.float32), intercept)


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    used = model.weights != 0
    z = np.array([model.weights[x].sum(dtype=np.float64) for x in _present(texts, used)]) if len(texts) else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(z + model.intercept, -700, 700)))


def _scorer(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(sent.value, batch.column(1).to_pylist()))], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(_scorer(sent), f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
