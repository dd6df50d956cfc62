"""Hard negatives: for each anchor and each of its best positives, the best rows of other labels in a window of scores.

A component x counts as floor(256 * x), x as double; a score is the integer inner product with the
anchor. Scores of anchors against a shard's rows come as tiles of an integer matrix product by
Strassen's recursion: seven products of quadrants in place of eight, zeros added to odd edges, int64
throughout, exact as long as a score fits 64 bits (beyond, it wraps). A first pass gathers each
anchor's heap of positives, a second one a heap for each window; heaps of all shards are merged, the
higher score first, the smaller id on a tie.

No part take: rows without an id, a label or a vector; with a null or non-finite component; with a
vector of another length than most have. Rows that repeat whole count once. Different rows under one
id are rows of their own, but none is a positive or negative of an anchor of that id; as an anchor
such an id stands for the least of them by label and vector. An anchor without a positive, and a
window without a negative, give no row. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._grid import SERVED, SHARD_BYTES, grid, matrix, profile, ragged, serve, shards_for, usable

#: Edges of a tile, and the edge at which the recursion stops.
ANCHORS, ROWS = 256, 4_096
LEAF = 32


def _product(a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """a @ b; all edges even as long as they are above leaf."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    m, k, n = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = _product(a11 + a22, b11 + b22, leaf)
    p2 = _product(a21 + a22, b11, leaf)
    p3 = _product(a11, b12 - b22, leaf)
    p4 = _product(a22, b21 - b11, leaf)
    p5 = _product(a11 + a12, b22, leaf)
    p6 = _product(a21 - a11, b11 + b12, leaf)
    p7 = _product(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b in int64; zeros fill each edge up to a multiple of 2 ** levels."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    levels = 0
    while min(m, k, n) > leaf << levels:
        levels += 1
    up = lambda x: -(-x >> levels) << levels
    if (up(m), up(k), up(n)) != (m, k, n):
        a = np.pad(a, ((0, up(m) - m), (0, up(k) - k)))
        b = np.pad(b, ((0, up(k) - k), (0, up(n) - n)))
    return _product(a, b, leaf)[:m, :n]


def _whole(vectors: pa.ListArray) -> np.ndarray:
    """floor(256 * x), held within 64 bits."""
    return np.clip(np.floor(256.0 * matrix(vectors, np.float64)), -(2.0**62), 2.0**62).astype(np.int64)


def _shard(rows: list[pa.StructArray]) -> dict:
    """A shard's rows by id, each once."""
    one = pa.concat_arrays(rows)
    ids, labels, table = one.field("id").to_numpy(), one.field("label").to_numpy(), _whole(one.field("vector"))
    order = np.lexsort((labels, ids))
    ids, labels, table = ids[order], labels[order], table[order]
    again = np.zeros(len(ids), bool)  # a row like one before it that has the same id
    for k in np.flatnonzero(np.diff(ids) == 0).tolist():
        first = int(np.searchsorted(ids, ids[k + 1]))
        again[k + 1] = bool(((labels[first : k + 1] == labels[k + 1]) & (table[first : k + 1] == table[k + 1]).all(1)).any())
    return {"ids": ids[~again], "labels": labels[~again], "columns": np.ascontiguousarray(table[~again].T)}


def _best(scores: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of the places `at`, in order of id, those of the n highest scores, in order."""
    if len(at) > n:
        own = scores[at]
        at = at[own >= np.partition(own, len(own) - n)[len(own) - n]]
    return at[np.argsort(-scores[at], kind="stable")[:n]]


class _Heap:
    """The n best of what is added, by score, then id."""

    def __init__(self, n: int):
        self.n, self.scores, self.ids = n, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(ids):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            order = np.lexsort((ids, -scores))[: self.n]
            self.scores, self.ids = scores[order], ids[order]


def _tiles(shard: dict, vectors: np.ndarray):
    """First anchor, first row and scores of each tile."""
    for a in range(0, len(vectors), ANCHORS):
        for r in range(0, len(shard["ids"]), ROWS):
            yield a, r, strassen(vectors[a : a + ANCHORS], shard["columns"][:, r : r + ROWS])


def _positives(n: int):
    def answer(shard: dict, asked: pa.StructArray) -> pa.RecordBatch:
        ids, labels = asked.field("id").to_numpy(), asked.field("label").to_numpy()
        heaps = [_Heap(n) for _ in ids]
        for a, r, scores in _tiles(shard, _whole(asked.field("vector"))):
            own_ids, own_labels = shard["ids"][r : r + ROWS], shard["labels"][r : r + ROWS]
            for i, s in enumerate(scores, a):
                best = _best(s, np.flatnonzero((own_labels == labels[i]) & (own_ids != ids[i])), n)
                heaps[i].add(s[best], own_ids[best])
        found = [h.ids for h in heaps], [h.scores for h in heaps]
        return pa.RecordBatch.from_arrays([pa.array(ids), *[ragged(x, pa.int64()) for x in found]], ["id", "ids", "scores"])

    return answer


def _windows(n: int, low: int, high: int):
    """A row for each anchor and window that has a row in the shard; place: the positive's, from 0."""

    def answer(shard: dict, asked: pa.StructArray) -> pa.RecordBatch:
        ids, labels = asked.field("id").to_numpy(), asked.field("label").to_numpy()
        tops = [x.values.to_numpy(zero_copy_only=False) for x in asked.field("scores")]
        heaps = [[_Heap(n) for _ in own] for own in tops]
        for a, r, scores in _tiles(shard, _whole(asked.field("vector"))):
            own_ids, own_labels = shard["ids"][r : r + ROWS], shard["labels"][r : r + ROWS]
            for i, s in enumerate(scores, a):
                if not len(tops[i]):
                    continue
                # below the lowest window or above the highest no row counts
                near = np.flatnonzero((100 * s >= low * tops[i].min()) & (100 * s <= high * tops[i].max()) & (own_labels != labels[i]) & (own_ids != ids[i]))
                for top, heap in zip(tops[i].tolist(), heaps[i]):
                    best = _best(s, near[(100 * s[near] >= low * top) & (100 * s[near] <= high * top)], n)
                    heap.add(s[best], own_ids[best])
        rows = [(i, p, h) for i, own in enumerate(heaps) for p, h in enumerate(own) if len(h.ids)]
        found = [h.ids for _, _, h in rows], [h.scores for _, _, h in rows]
        return pa.RecordBatch.from_arrays([pa.array(ids[[i for i, _, _ in rows]], pa.int64()), pa.array([p for _, p, _ in rows], pa.int32()), *[ragged(x, pa.int64()) for x in found]], ["id", "place", "ids", "scores"])

    return answer


def _merged(parts: DataFrame, n: int, *keys: str) -> DataFrame:
    """The heaps of a key's shards as one: `best`, n structs (score, id) at most, in order."""
    pairs = F.flatten(F.collect_list(F.arrays_zip("scores", "ids")))
    ordered = F.array_sort(F.transform(pairs, lambda x: F.struct((-x["scores"]).alias("low"), x["ids"].alias("id"))))
    return parts.groupBy(*keys).agg(F.slice(ordered, 1, n).alias("best"))


def mine(rows: DataFrame, is_anchor: Column, id: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, shard_bytes: int = SHARD_BYTES, served: int = SERVED) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: for each anchor and each of its `positives` best rows of its label, the `negatives` best rows of other labels whose score is from low to high percent of the positive's."""
    kept = rows.where(F.col(id).isNotNull() & F.col(label).isNotNull() & usable(vector)).withColumn("_anchor", F.coalesce(is_anchor, F.lit(False)))
    kept = kept.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), "_anchor")
    shape = profile(kept, "vector")
    kept = kept.where(F.size("vector") == shape.dim)
    shards = shards_for(rows, shape.rows, shape.dim, shard_bytes)
    anchors = kept.where("_anchor").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.*")
    salts = -(-anchors.count() // served) or 1
    held = kept.drop("_anchor")

    tops = grid(held, anchors, shards, salts, "id").mapInArrow(serve(_shard, _positives(positives)), "id long, ids array<long>, scores array<long>")
    best = _merged(tops, positives, "id").where(F.size("best") > 0)
    asked = anchors.join(best, "id").withColumn("scores", F.transform("best", lambda x: -x["low"]))
    windows = grid(held, asked.select("id", "label", "vector", "scores"), shards, salts, "id").mapInArrow(serve(_shard, _windows(negatives, low, high)), "id long, place int, ids array<long>, scores array<long>")
    found = _merged(windows, negatives, "id", "place").select("id", "place", F.posexplode("best").alias("at", "negative"))
    positive = asked.select("id", F.posexplode("best").alias("place", "positive"))
    return found.join(positive, ["id", "place"]).select(
        F.col("id").alias("anchor_id"),
        F.col("positive.id").alias("positive_id"),
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("negative.id").alias("negative_id"),
        (-F.col("positive.low")).alias("positive_score"),
        (-F.col("negative.low")).alias("negative_score"),
    )
