"""Concatenate and cut: documents' ids in one long row, cut into windows of a fixed length.

Pass 1 encodes each partition where it lies, with no shuffle, and writes the ids with their start in
the partition. Prefix sums over the partitions' totals give global starts. Pass 2 cuts at multiples
of the window; a document that crosses a cut gives one piece (boundary record) on each side. Only
the last sequence isn't full.

A null text is an empty one: its end id alone. Rows that share a doc_id, or have none, are documents
of their own; doc_id keeps its type. Other columns aren't kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._stage import staged
from ._tokens import encoder
from ._worker import parts


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, at = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], code.dtype).tobytes()
        size = code.dtype.itemsize
        for batch in parts(batches):
            ids = [x.tobytes() + end for x in code.encode_column(batch.column(1))]
            n = np.array([len(x) // size for x in ids], np.int64)
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), batch.column(0), pa.array(start), pa.array(n), pa.array([size] * len(ids), pa.int32()), pa.array(ids, pa.binary())], ["part", "doc_id", "at", "n", "size", "ids"])

    return run


def encoded_partitions(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(part, doc_id, at, n, size, ids): each document's ids, of size bytes each, and its start in its partition; written in the shared folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return staged(docs.select("doc_id", "text").mapInArrow(_encode(tokenizer_path, end_id), f"part int, doc_id {kind}, at long, n long, size int, ids binary"), "packing-ids")


def partition_starts(encoded: DataFrame) -> DataFrame:
    """(part, base): ids of all partitions before it. One row for each partition."""
    totals = encoded.groupBy("part").agg(F.sum("n").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))


def _cut(window: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            begin, n, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("begin", "n", "size"))
            first, last = begin // window, (begin + n - 1) // window
            many = last - first + 1
            row = np.repeat(np.arange(len(n)), many)
            sequence = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
            low = np.maximum(sequence * window, begin[row])
            high = np.minimum((sequence + 1) * window, (begin + n)[row])
            start, length = low - begin[row], high - low
            pieces, crcs, of, ids = [], [], -1, b""
            for r, a, b in zip(row.tolist(), start.tolist(), (start + length).tolist()):
                if r != of:
                    of, ids = r, np.frombuffer(batch.column("ids")[r].as_py(), f"<u{size[r]}").astype("<u4")
                piece = ids[a:b].tobytes()
                crcs.append(zlib.crc32(piece))
                if with_ids:
                    pieces.append(piece)
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(n[row]), pa.array(sequence), pa.array(low - sequence * window)]
            more = [pa.array(pieces, pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays([*columns, *more], [*names, *["ids"] * with_ids])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = 1024, with_ids: bool = True) -> DataFrame:
    """docs (doc_id, text) -> pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids: little-endian unsigned 32-bit integers)."""
    encoded = encoded_partitions(docs, tokenizer_path, end_id)
    # a row for each partition of the input: as many as tasks that encoded
    placed = encoded.join(F.broadcast(partition_starts(encoded)), "part").select("doc_id", (F.col("base") + F.col("at")).alias("begin"), "n", "size", "ids")
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(_cut(window, with_ids), f"{shape}, ids binary" if with_ids else shape)


def sequences(pieces: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n, ids): the pieces of each sequence put together, n ids, and pad_id up to the window; at most one window of ids in a group."""
    placed = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.aggregate(placed, F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
    pad = F.lit(int(pad_id).to_bytes(4, "little"))
    padding = F.array_repeat(pad, (window - F.col("n")).cast("int"))
    return whole.withColumn("ids", F.aggregate(padding, F.col("ids"), lambda a, x: F.concat(a, x)))
