"""Hashed character n-grams of whole columns of text, and sums of dense counts over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._worker import parts, release

CHUNK = 1 << 19
BLOCK = 1 << 13
_PLAIN = np.arange(128, dtype=np.uint32)
_PLAIN[[c for c in range(128) if not chr(c).isalpha()]] = 32


def chunks(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, characters, edges): code points in lower case, with a space for every ASCII character that isn't a letter, and one before and after each document. A slice has CHUNK characters, or one longer document."""
    held, size, first = [], 0, 0
    for k, text in enumerate(texts):
        held.append(f" {(text or '').lower()} ")
        size += len(held[-1])
        if size >= CHUNK or k == len(texts) - 1:
            points = np.frombuffer("".join(held).encode("utf-32-le", "replace"), np.uint32).copy()
            low = points < 128
            points[low] = _PLAIN[points[low]]
            yield first, points, np.concatenate([[0], np.cumsum([len(x) for x in held])])
            held, size, first = [], 0, k + 1


def codes(points: np.ndarray, edges: np.ndarray, order: int, bins: int) -> np.ndarray:
    """The bin of the n-gram that starts at each character; `bins` (one more than the last) where it would cross the document's end."""
    n = len(points) - order + 1
    out = np.full(len(points), bins, np.int32)
    if n <= 0:
        return out
    h = np.full(n, 0x9E3779B1 * order & 0xFFFFFFFF, np.uint32)
    for j in range(order):
        h ^= points[j : n + j]
        h *= np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    out[:n] = h % np.uint32(bins)
    for back in range(1, order):
        at = edges[1:] - back
        out[at[at >= 0]] = bins
    return out


def dense_counts(rows: DataFrame, names: list[str], count: Callable[[pa.RecordBatch, dict[str, np.ndarray]], None], bins: int) -> dict[str, np.ndarray]:
    """Arrays of `bins` counts by name, added up over all batches: each task sends its arrays in blocks, Spark adds those of a block. What reaches the driver is len(names) * bins numbers, whatever the input."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        totals = {n: np.zeros(bins, np.int64) for n in names}
        for batch in parts(batches):
            count(batch, totals)
        for name, total in totals.items():
            for at in range(0, bins, BLOCK):
                if (part := total[at : at + BLOCK]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["name", "at", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, at, part in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(part, np.int64)
                key = (name, at)
                sums[key] = sums[key] + x if key in sums else x
        for (name, at), x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["name", "at", "counts"])

    shape = "name string, at int, counts binary"
    summed = rows.mapInArrow(gather, shape).repartition("name", "at").mapInArrow(add, shape)
    out = {n: np.zeros(bins, np.int64) for n in names}
    for r in summed.toLocalIterator():
        part = np.frombuffer(r["counts"], np.int64)
        out[r["name"]][r["at"] : r["at"] + len(part)] += part
    return out
