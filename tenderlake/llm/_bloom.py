"""A Bloom filter of fixed size over 64-bit keys, built by Spark in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import mix

BLOCK_BITS = 16
PROBES = 3
MAX_BYTES = 64 << 20


def _bits(keys: np.ndarray) -> np.ndarray:
    """Places in a block, a column for each probe."""
    h = mix(keys ^ np.uint64(0xA0761D6478BD642F))
    return np.stack([(h >> np.uint64(BLOCK_BITS * k)) & np.uint64((1 << BLOCK_BITS) - 1) for k in range(PROBES)], 1).astype(np.int64)


class Bloom:
    """May say yes to a key that isn't in it, never no to one that is."""

    def __init__(self, power: int, blocks: dict[int, bytes]):
        self.power = power
        self.data = np.zeros((1 << power, 1 << (BLOCK_BITS - 3)), np.uint8)
        for k, raw in blocks.items():
            self.data[k] = np.frombuffer(raw, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        block = (keys >> np.uint64(64 - self.power)).astype(np.int64)
        out = np.ones(len(keys), bool)
        for bit in _bits(keys).T:
            out &= (self.data[block, bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
        return out


def _fill(power: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            block = (keys >> np.uint64(64 - power)).astype(np.int64)
            for k in np.unique(block):
                marks = blocks.setdefault(int(k), np.zeros(1 << BLOCK_BITS, np.uint8))
                marks[_bits(keys[block == k]).ravel()] = 1
        for k, marks in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(marks, bitorder="little").tobytes()])], ["block", "bits"])

    return run


def build(keys: DataFrame, count: int, max_bytes: int = MAX_BYTES) -> Bloom:
    """keys: one long column; count: their number. About 12 bits a key, max_bytes at most: beyond that the filter lets more through, and keeps nothing out that belongs."""
    power = 1
    while (1 << (power + BLOCK_BITS)) < 12 * count and (1 << (power + BLOCK_BITS - 2)) <= max_bytes:
        power += 1
    name = keys.columns[0]
    dealt = keys.repartition(F.shiftrightunsigned(name, 64 - power))
    rows = dealt.mapInArrow(_fill(power), "block long, bits binary").toLocalIterator()
    return Bloom(power, {r["block"]: bytes(r["bits"]) for r in rows})
