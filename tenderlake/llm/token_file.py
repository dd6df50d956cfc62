"""Token ids in files: fixed-width bit packing in blocks.

A dataset is a folder of Parquet files, so that any store Spark knows can hold it and its write
commits as a whole. A row is a block of whole documents: `payload` holds every id in `width` bits,
lowest bit first, `ends` the documents' ends counted in ids (the block's offsets), `first` the ids
before the block in its shard. Id k of a block starts at bit k * width: `unpack` reads any range of
a block with numpy and no loop. Shards hold ascending ranges of doc_id.

A null text is an empty one: its end id alone. Rows that share a doc_id follow each other by a hash
of their text, and copies as they were read; rows without a doc_id come first. doc_id keeps its type.
A block has BLOCK_IDS ids, or one document that is longer. Other columns aren't kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tokens import encoder
from ._worker import parts

BLOCK_IDS = 1 << 16
BLOCKS = "shard int, block int, first long, width int, doc_ids array<{}>, ends array<long>, payload binary"


def bits(vocabulary: int) -> int:
    """Bits that the largest id needs."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, end: int) -> np.ndarray:
    """Ids start .. end - 1 of a block, as little-endian unsigned 32-bit integers."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", end - start, start * width // 8).astype("<u4")
    low, high = start * width, end * width
    raw = np.unpackbits(np.frombuffer(payload, np.uint8)[low // 8 : -(-high // 8)], bitorder="little")
    each = raw[low % 8 : low % 8 + high - low].reshape(-1, width).astype(np.uint32)
    return (each << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32).astype("<u4")


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard = encoder(path), TaskContext.get().partitionId()
        width, block, first = bits(max(code.vocabulary, end_id + 1)), 0, 0
        names: list = []
        ids_of: list[np.ndarray] = []
        held, end = 0, np.array([end_id], code.dtype)

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([len(p) for p in ids_of])
            row = [[shard], [block], [first], [width], [names], [ends.tolist()], [pack(np.concatenate(ids_of), width)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(kind), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["shard", "block", "first", "width", "doc_ids", "ends", "payload"])

        for batch in parts(batches):
            kind = batch.column(0).type
            for name, ids in zip(batch.column(0).to_pylist(), code.encode_column(batch.column(1))):
                ids = np.concatenate([ids, end])
                if held and held + len(ids) > BLOCK_IDS:
                    yield flush()
                    block, first, names, ids_of, held = block + 1, first + held, [], [], 0
                names.append(name)
                ids_of.append(ids)
                held += len(ids)
        if held:
            yield flush()

    return run


def write_token_file(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Encode docs (doc_id, text) and write their ids, each document closed by end_id, in ascending doc_id order."""
    # the last key lets copies of one row, however many, lie in several ranges
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_rank"), F.monotonically_increasing_id().alias("_turn"))
    by = ("doc_id", "_rank", "_turn")
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered.mapInArrow(_encode(tokenizer_path, end_id), BLOCKS.format(kind)).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def shard_starts(blocks: DataFrame) -> DataFrame:
    """(shard, base): ids of all shards before it. One row for each shard that was written."""
    totals = blocks.groupBy("shard").agg(F.sum(F.element_at("ends", -1)).alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, first, width, doc_ids, ends, payload in zip(*(batch.column(c) for c in ("shard", "first", "width", "doc_ids", "ends", "payload"))):
            end = np.array(ends.as_py(), np.int64)
            start = np.concatenate([[0], end[:-1]]).astype(np.int64)
            ids = unpack(payload.as_py(), width.as_py(), 0, int(end[-1]))
            cut = [ids[a:b].tobytes() for a, b in zip(start, end)]
            columns = [pa.array([shard.as_py()] * len(end), pa.int32()), doc_ids.values, pa.array(start + first.as_py()), pa.array(end - start), pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "at", "n_tokens", "ids_crc32", "ids"])


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): every document, read back; ids are little-endian unsigned 32-bit integers."""
    blocks = read_blocks(spark, path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    docs = blocks.mapInArrow(_decode, f"shard int, doc_id {kind}, at long, n_tokens long, ids_crc32 long, ids binary")
    # a row for each shard: as many as tasks that wrote
    return docs.join(F.broadcast(shard_starts(blocks)), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")


def read_ids(spark: SparkSession, path: str, shard: int, start: int, end: int) -> np.ndarray:
    """Random access: ids start .. end - 1 of a shard; only the blocks that hold them are read."""
    blocks = read_blocks(spark, path).where((F.col("shard") == shard) & (F.col("first") < end) & (F.col("first") + F.element_at("ends", -1) > start))
    parts = []
    for r in blocks.select("first", "width", "payload", F.element_at("ends", -1).alias("n")).orderBy("first").toLocalIterator():
        parts.append(unpack(r.payload, r.width, max(0, start - r.first), min(r.n, end - r.first)))
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")
