"""Words and hashes of whole Arrow columns of text, computed with numpy inside tasks.

A column is read as one byte buffer with offsets. Documents are handled in slices of about
CHUNK bytes (never cutting a document), so memory follows the longest document, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_P = 0x9E3779B97F4A7C15
_Q = np.uint64(0xC2B2AE3D27D4EB4F)

#: Bytes \x20 and \x09-\x0D end a word.
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"

NOT_BLANK = np.ones(256, bool)
NOT_BLANK[list(BLANK)] = False
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased: digits, letters and all of non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values (murmur3's)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i below n at least."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; a null has no bytes."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of the documents first .. first + len(counts) - 1 of a column."""

    first: int
    buf: np.ndarray  # the bytes they are in
    start: np.ndarray  # of each word in buf
    end: np.ndarray
    counts: np.ndarray  # words of each document
    edge: np.ndarray  # first word of each document, and the number of words at the end
    at: np.ndarray  # first byte of each document in buf, and the number of bytes at the end

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes, or of other ranges of bytes."""
        start, end = (self.start, self.end) if start is None else (start, end)
        n = len(self.buf)
        power, inverse = _power(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.buf] * power[:n], out=total[1:])
        return mix((total[end] - total[start]) * inverse[start])


def words_of(column: pa.Array, table: np.ndarray = NOT_BLANK, lower: bool = False) -> Iterator[Words]:
    """table: which bytes belong to words, after lower-casing A-Z where lower is true."""
    data, offsets = buffer_of(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        buf = data[offsets[at] : offsets[to]]
        if lower:
            buf = LOWER[buf]
        edges = offsets[at : to + 1] - offsets[at]
        inside = table[buf]
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cut = edges[(edges > 0) & (edges < len(buf))]
        start[cut] |= inside[cut]
        end[cut - 1] |= inside[cut - 1]
        start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
        edge = np.searchsorted(start, edges)
        yield Words(at, buf, start, end, np.diff(edge), edge, edges)
        at = to


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive values; len(h) - k + 1 of them, or none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= _Q
        g += h[j : n + j]
    return mix(g)
