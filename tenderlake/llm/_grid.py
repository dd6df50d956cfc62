"""Stated queries against all rows, in blocks: rows lie in shards that a task can hold, queries pass by.

A cell is a shard and one of `salts` parts of the queries. Its rows come first and are held, then its
queries come in slices; each gets what the shard has for it, so a query's answers are one row a shard,
to be merged. Rows are dealt by a hash of their id, so a group of copies is spread like any others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._worker import parts

#: Bytes of vectors (8 a component) that a shard may hold, and queries that a task answers against it.
SHARD_BYTES = 64 << 20
SERVED = 1 << 16


@dataclass(frozen=True)
class Profile:
    """What a pass over the usable rows tells: their number, their vectors' length, the longest norm."""

    rows: int
    dim: int
    norm: float


def usable(vector: str) -> Column:
    """A vector with components, none of them null or not finite."""
    x = F.col(vector)
    return x.isNotNull() & (F.size(x) > 0) & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


def profile(rows: DataFrame, vector: str) -> Profile:
    """Of usable rows. The dimension is the length that most vectors have, the least on a tie."""
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    lengths = rows.groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("rows"), F.max(norm).alias("norm"))
    most = lengths.orderBy(F.desc("rows"), "dim").first()
    return Profile(most["rows"], most["dim"], most["norm"]) if most else Profile(0, 0, 0.0)


def shards_for(df: DataFrame, rows: int, dim: int, shard_bytes: int = SHARD_BYTES) -> int:
    """As many as the bytes ask for, and enough for all of a small cluster's cores."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows * max(dim, 1) * 8 // shard_bytes), 1)


def grid(held: DataFrame, asked: DataFrame, shards: int, salts: int, key: str) -> DataFrame:
    """(shard, salt, turn, held, asked): of each cell its rows of held (turn 0), then its queries (turn 1). Both frames have the column `key`."""
    pack = lambda df: F.struct(*[F.col(f"`{c}`") for c in df.columns])
    none = lambda df: F.lit(None).cast(df.select(pack(df).alias("x")).schema["x"].dataType)
    # another hash than the one that deals rows to partitions
    dealt = lambda n: F.pmod(F.xxhash64(F.col(key), F.lit("grid")), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = held.select(dealt(shards).alias("shard"), every(salts).alias("salt"), F.lit(0).alias("turn"), pack(held).alias("held"), none(asked).alias("asked"))
    rows = asked.select(every(shards).alias("shard"), dealt(salts).alias("salt"), F.lit(1).alias("turn"), none(held).alias("held"), pack(asked).alias("asked"))
    return own.union(rows).repartition(shards * salts, "shard", "salt").sortWithinPartitions("shard", "salt", "turn")


def serve(build: Callable[[list[pa.StructArray]], Any], answer: Callable[[Any, pa.StructArray], pa.RecordBatch]):
    """A mapInArrow function over grid(): build makes of a cell's rows what answer asks for a slice of queries. Cells without rows answer nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows, made = None, [], None
        for batch in parts(batches, rows=4_096):
            shard, salt, turn = (batch.column(c).to_numpy() for c in ("shard", "salt", "turn"))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0) | (np.diff(turn) != 0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if low == high:
                    continue
                if (shard[low], salt[low]) != cell:
                    cell, rows, made = (shard[low], salt[low]), [], None
                if turn[low] == 0:
                    rows.append(pa.concat_arrays([batch.column("held").slice(low, high - low)]))
                elif rows or made is not None:
                    if made is None:
                        made, rows = build(rows), []
                    yield answer(made, batch.column("asked").slice(low, high - low))

    return run


def matrix(vectors: pa.ListArray, dtype: type) -> np.ndarray:
    """A row for each vector; all have the same length and no nulls."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def ragged(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column of arrays of different lengths."""
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rows]) if rows else [], kind))
