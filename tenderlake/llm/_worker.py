"""What a Python worker holds: slices of batches, and what it keeps from one task to the next."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

#: Rows and bytes that a task works on at once, whatever the size of Spark's batches.
ROWS, BYTES = 2_000, 4 << 20

_kept: dict[Any, Any] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def keep(key: Any, make: Callable[[], Any]) -> Any:
    """The value made for key. One value is kept: what an operator leaves goes when a task of another begins, so workers that Spark uses again don't grow."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Keep nothing, and give unused memory back."""
    _kept.clear()
    trim()


def trim() -> None:
    """Give back what Arrow and the C library hold for later: idle workers stay, and share the machine with the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Batches in slices of `rows` rows or about `size` bytes (one row at least); memory is given back at the end."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)
    trim()
