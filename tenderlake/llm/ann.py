"""Nearest neighbours by largest inner product: multi-index hashing of learned rotated binary codes.

Learning, on SAMPLE vectors at most (the first by a hash of their ids): rows are centred, and get one
component more that brings all to one length, so that angles order them as inner products do; the
principal axes are rotated until signs lose least (iterative quantisation, a rotation for each
len(axes) bits), and a code is the signs. The radius is the Hamming distance within which RECALL of
the sample's own k nearest lie; nearest rows of the whole table are nearer still.

The index holds every row, in shards (`_grid`). Within one, codes are cut into substrings of 16 bits,
each with a directory of the values that occur and their rows. If two codes differ in r bits at most,
of m substrings r % m + 1 differ in r // m bits at most or one of the others in r // m - 1 (pigeonhole):
a query visits those values, by flipping bits or along the directory, whichever is shorter, and keeps the
codes within the radius. A shard that has fewer than k of them for a query widens the radius for it
until it has k, or all. Distances of the codes only choose; what they choose is ranked by the inner
products of the vectors themselves. Equal vectors of a shard are one code with a list of ids.

The result is approximate (tests and README state the recall) but its scores are exact and every
query gets k rows, if there are as many. No part take: rows without an id, null and zero vectors, null
or non-finite components, vectors of another length than most have. Rows that repeat count once;
different vectors under one id are one item, as near as the nearer of them, and as a query such an id
asks with the least of them. Other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._grid import SERVED, SHARD_BYTES, Profile, grid, matrix, profile, ragged, serve, shards_for, usable
from ._worker import keep

SAMPLE = 20_000
ASKED = 256
ROUNDS = 40
BITS = 128
RECALL = 0.98
_WORD = 16
_SLICE = 8_192


@dataclass
class Model:
    centre: np.ndarray
    longest: float  # of the centred rows
    rotation: np.ndarray  # (dim + 1, bits)
    radius: int

    @property
    def substrings(self) -> int:
        return self.rotation.shape[1] // _WORD

    def _bits(self, wide: np.ndarray) -> np.ndarray:
        return np.packbits(wide @ self.rotation > 0, axis=1).view(">u2").astype(np.uint16)

    def widened(self, x: np.ndarray) -> np.ndarray:
        """Centred rows with the component that brings all to one length."""
        own = x - self.centre
        return np.hstack([own, np.sqrt(np.maximum(self.longest**2 - (own**2).sum(1), 0.0))[:, None]])

    def code_rows(self, x: np.ndarray) -> np.ndarray:
        """(rows, substrings)."""
        return np.concatenate([np.zeros((0, self.substrings), np.uint16), *(self._bits(self.widened(x[k : k + _SLICE])) for k in range(0, len(x), _SLICE))])

    def code_queries(self, x: np.ndarray) -> np.ndarray:
        return self._bits(np.hstack([x, np.zeros((len(x), 1))]))


def _rotations(wide: np.ndarray, bits: int, rng: np.random.Generator) -> np.ndarray:
    """Orthogonal directions, in blocks, each turned from a start of its own so that signs lose least."""
    _, _, axes = np.linalg.svd(wide - wide.mean(0), full_matrices=False)
    reduced = wide @ axes.T
    blocks, n = [], 0
    while n < bits:
        turn = np.linalg.qr(rng.standard_normal((reduced.shape[1],) * 2))[0]
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(np.where(reduced @ turn > 0, 1.0, -1.0).T @ reduced)
            turn = (left @ right).T
        blocks.append(axes.T @ turn)
        n += blocks[-1].shape[1]
    return np.hstack(blocks)[:, :bits]


def distances(codes: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ query).sum(1, dtype=np.int64)


def learn(x: np.ndarray, longest: float, k: int, bits: int = BITS, recall: float = RECALL) -> Model:
    """From a sample; longest: the longest norm of all rows."""
    rng = np.random.default_rng(11)
    centre = x.mean(0)
    # no centred row is longer than this
    longest = longest + float(np.linalg.norm(centre))
    model = Model(centre, longest, np.zeros((0, bits)), bits)
    model.rotation = _rotations(model.widened(x), bits, rng)
    asked = rng.choice(len(x), min(ASKED, len(x)), replace=False)
    codes, queries = model.code_rows(x), model.code_queries(x[asked])
    far = []
    for i, q in zip(asked.tolist(), queries):
        scores = x @ x[i]
        scores[i] = -np.inf
        near = np.argsort(-scores, kind="stable")[: min(k, len(x) - 1)]
        far.append(distances(codes[near], q))
    if len(x) > 1:
        model.radius = int(np.quantile(np.concatenate(far), recall, method="higher"))
    return model


@lru_cache
def _flips(bits: int) -> np.ndarray:
    """The 16-bit words with at most so many bits set."""
    return np.array([sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(_WORD), n)], np.uint16)


@lru_cache
def _flip_count(bits: int) -> int:
    n = total = 1
    for i in range(bits):
        n = n * (_WORD - i) // (i + 1)
        total += n
    return total


class Index:
    """The codes of distinct vectors, with a directory for each substring."""

    def __init__(self, model: Model, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.append(True, (vectors[1:] != vectors[:-1]).any(1))
        once = new | np.append(True, ids[1:] != ids[:-1])
        ids, vectors, new = ids[once], vectors[once], new[once]
        self.model, self.vectors = model, vectors[new]
        self.ids, self.first = ids, np.append(np.flatnonzero(new), len(ids))
        self.vectors_an_id = int(np.unique(ids, return_counts=True)[1].max())
        self.codes = model.code_rows(self.vectors)
        self.tables = []
        for words in self.codes.T:
            rows = np.argsort(words, kind="stable")
            values, start = np.unique(words[rows], return_index=True)
            self.tables.append((values, np.append(start, len(rows)), rows))

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """The codes within that Hamming distance of the query's, all of them."""
        m, found = len(self.tables), np.zeros(len(self.codes), bool)
        for j, (values, start, rows) in enumerate(self.tables):
            near = radius // m - (j > radius % m)
            if near < 0:
                continue
            if near < _WORD and 4 * _flip_count(near) < len(values):
                flipped = _flips(near) ^ query[j]
                at = np.minimum(np.searchsorted(values, flipped), len(values) - 1)
                at = at[values[at] == flipped]
            else:
                at = np.flatnonzero(np.bitwise_count(values ^ query[j]) <= near)
            n = start[at + 1] - start[at]
            found[rows[np.arange(n.sum()) + np.repeat(start[at] - np.cumsum(n) + n, n)]] = True
        rows = np.flatnonzero(found)
        return rows[distances(self.codes[rows], query) <= radius]

    def nearest(self, own: int, vector: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best of the rows within the radius, without the id `own`."""
        bits, radius = self.model.rotation.shape[1], self.model.radius
        most = (k + 1) * self.vectors_an_id
        while True:
            rows = self.within(code, radius)
            if int((self.first[rows + 1] - self.first[rows]).sum()) >= most or radius >= bits:
                break
            radius = min(bits, radius + max(1, bits // 16))
        # in one order of addition, so that equal vectors have equal scores
        scores = (self.vectors[rows].astype(np.float64) * vector).sum(1)
        if len(rows) > most:
            good = scores >= np.partition(scores, len(scores) - most)[len(scores) - most]
            rows, scores = rows[good], scores[good]
        n = np.minimum(self.first[rows + 1] - self.first[rows], most)
        at = np.arange(n.sum()) + np.repeat(self.first[rows] - np.cumsum(n) + n, n)
        ids, scores = self.ids[at], np.repeat(scores, n)
        order = np.lexsort((ids, -scores))
        order = order[ids[order] != own]
        _, once = np.unique(ids[order], return_index=True)
        order = order[np.sort(once)][:k]
        return ids[order], scores[order]


def _build(sent):
    number = sent._jbroadcast.id()

    def build(rows: list[pa.StructArray]) -> Index:
        model = keep(("codes", number), lambda: sent.value)
        one = pa.concat_arrays(rows)
        return Index(model, one.field("id").to_numpy(), matrix(one.field("vector"), np.float64))

    return build


def _answer(k: int):
    def answer(index: Index, asked: pa.StructArray) -> pa.RecordBatch:
        ids, vectors = asked.field("id").to_numpy(), matrix(asked.field("vector"), np.float64)
        found = [index.nearest(int(i), v, c, k) for i, v, c in zip(ids, vectors, index.model.code_queries(vectors))]
        return pa.RecordBatch.from_arrays([pa.array(ids), ragged([x for x, _ in found], pa.int64()), ragged([x for _, x in found], pa.float64())], ["id", "ids", "scores"])

    return answer


def candidates(rows: DataFrame, is_query: Column, id: str, vector: str) -> tuple[DataFrame, Profile]:
    """(id, vector, asks) of the rows that take part, and their profile."""
    zero = ~F.exists(F.col(vector), lambda v: v != 0)
    kept = rows.where(F.col(id).isNotNull() & usable(vector) & ~zero)
    kept = kept.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    shape = profile(kept, "vector")
    return kept.where(F.size("vector") == shape.dim), shape


def train(kept: DataFrame, shape: Profile, k: int, sample: int = SAMPLE, bits: int = BITS) -> Model | None:
    """Codes and radius from `sample` rows of candidates() at most; None without rows."""
    drawn = kept.orderBy(F.xxhash64("id"), "id", "vector").limit(sample).select("vector").toArrow().column("vector")
    return learn(matrix(pa.concat_arrays(drawn.chunks), np.float64), shape.norm, k, bits) if len(drawn) else None


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, bits: int = BITS, shard_bytes: int = SHARD_BYTES, served: int = SERVED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that is_query holds for, the k rows of largest inner product that are found."""
    spark = rows.sparkSession
    kept, shape = candidates(rows, is_query, id, vector)
    model = train(kept, shape, k, sample, bits)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = kept.where("asks").groupBy("id").agg(F.min("vector").alias("vector"))
    salts = -(-queries.count() // served) or 1
    sent = spark.sparkContext.broadcast(model)  # dim x bits numbers
    met = grid(kept.drop("asks"), queries, shards_for(rows, shape.rows, shape.dim, shard_bytes), salts, "id")
    found = met.mapInArrow(serve(_build(sent), _answer(k)), "id long, ids array<long>, scores array<double>")
    pairs = F.transform(F.flatten(F.collect_list(F.arrays_zip("scores", "ids"))), lambda x: F.struct((-x["scores"]).alias("low"), x["ids"].alias("id")))
    best = found.groupBy("id").agg(F.slice(F.array_sort(pairs), 1, k).alias("best"))
    ranked = best.select(F.col("id").alias("query_id"), F.posexplode("best").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.low")).alias("score"))
