"""Lines that many documents share, found through a sharded minimal perfect hash.

1. Every task hashes the distinct line keys of its documents (128 bits) and counts documents;
   Spark sums the counts of each hash. Keys below min_docs can never lose a line, so the index
   holds the others only.
2. The hashes are dealt to shards of about SHARD_KEYS keys. A task builds each shard: a minimal
   perfect hash by bucket displacement, whose slots hold a 64-bit fingerprint and a count.
3. Documents probe the arrays. An index of BROADCAST_BYTES at most is broadcast. A larger one stays
   where it is: a pass over the texts picks the lines that a Bloom filter of fixed size lets through,
   their hashes travel to the shards, are probed there, and hits go back to their documents. So the
   texts are read as often for any size, and the driver never holds an index beyond BROADCAST_BYTES.

A line that isn't a key is refused by its fingerprint, but for a chance of 2**-64 each.

Null or empty text is one empty line, kept. A line whose key is empty stays. Copies of a row
count as documents of their own. Other columns pass through unread; one that is named as a result
gives way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _bloom
from ._serve import beside
from ._stage import staged
from ._text import BLANK
from ._worker import parts

SHARD_KEYS = 20_000
BROADCAST_BYTES = 64 << 20
#: Lines that one task probes for a shard, about.
SERVED = 1_000_000
RESULTS = ("kept_text", "n_lines", "n_dropped", "kept_sha256")
_M64 = (1 << 64) - 1


def key_of(line: bytes) -> bytes:
    """Stripped of blanks at both ends, A-Z in lower case."""
    return line.strip(BLANK).lower()


def _digest(key: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(key)
    return d >> 64, d & _M64


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _count_lines(min_chars: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found: dict[bytes, int] = {}
            for text in batch.column(0).to_pylist():
                keys = set(map(key_of, (text or b"").split(b"\n")))
                keys.discard(b"")
                for key in keys:
                    found[key] = found.get(key, 0) + 1
            if min_chars > 1:
                found = {k: v for k, v in found.items() if len(k.decode("utf-8", "replace")) >= min_chars}
            pairs = np.array([_digest(k) for k in found], np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(pairs[:, 0])), pa.array(_signed(pairs[:, 1])), pa.array(list(found.values()), pa.int64())], ["hi", "lo", "docs"])

    return count


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(hi, lo, docs): each distinct line key's hash and the number of documents that have it."""
    each = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_count_lines(min_chars), "hi long, lo long, docs long")
    return each.groupBy("hi", "lo").agg(F.sum("docs").alias("docs"))


def _spread(hi: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    x = hi + (seed + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(n)).astype(np.int64)


def build_shard(hi: np.ndarray, lo: np.ndarray, docs: np.ndarray) -> dict[str, np.ndarray]:
    """A minimal perfect hash of distinct hi values: buckets of about four keys, largest first, each take the first seed that sends their keys to free slots."""
    n = len(hi)
    buckets = n // 4 + 1
    bucket = _spread(hi, np.full(n, 1 << 40, np.uint64), buckets)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    seeds, used = np.zeros(buckets, np.uint32), np.zeros(n, bool)
    fingerprints, counts = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        rows = order[begin[b] : begin[b + 1]]
        seed = 0
        while True:
            tries = np.arange(seed, seed + 64, dtype=np.uint64)
            slots = _spread(hi[rows][None, :], tries[:, None], n)
            good = ~used[slots].any(1)
            if len(rows) > 1:
                ordered = np.sort(slots, 1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(1)
            if good.any():
                k = int(np.argmax(good))
                seeds[b] = seed + k
                used[slots[k]] = True
                fingerprints[slots[k]], counts[slots[k]] = lo[rows], docs[rows]
                break
            seed += 64
    return {"seeds": seeds, "fingerprints": fingerprints, "counts": counts}


def probe(shard: dict[str, np.ndarray], hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The count of each hash, 0 for those that the shard doesn't hold."""
    n = len(shard["counts"])
    if not n:
        return np.zeros(len(hi), np.int64)
    bucket = _spread(hi, np.full(len(hi), 1 << 40, np.uint64), len(shard["seeds"]))
    slot = _spread(hi, shard["seeds"][bucket].astype(np.uint64), n)
    return np.where(shard["fingerprints"][slot] == lo, shard["counts"][slot], 0)


def _build(key: tuple, table: pa.Table) -> pa.Table:
    hi, lo = (table.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
    docs = table.column("docs").to_numpy()
    # keys that share all of hi (2**-64 a pair) can't be told apart by slot; the second goes to a list beside
    _, first = np.unique(hi, return_index=True)
    rest = np.setdiff1d(np.arange(len(hi)), first)
    shard = build_shard(hi[first], lo[first], docs[first])
    extra = np.stack([hi[rest], lo[rest], docs[rest].astype(np.uint64)]) if len(rest) else np.zeros((3, 0), np.uint64)
    return pa.table({"shard": [key[0].as_py()], "seeds": [shard["seeds"].tobytes()], "fingerprints": [shard["fingerprints"].tobytes()], "counts": [shard["counts"].tobytes()], "extra": [extra.tobytes()]})


def build_index(counts: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """The keys (hi, lo, docs) found in at least min_docs documents, and one row for each shard of them; both written in the shared folder."""
    keys = staged(counts.where(F.col("docs") >= min_docs), "line-keys")
    shards = max(1, -(-keys.count() // SHARD_KEYS))
    index = keys.withColumn("shard", F.pmod(F.col("hi"), F.lit(shards))).groupBy("shard").applyInArrow(_build, "shard long, seeds binary, fingerprints binary, counts binary, extra binary")
    return keys, staged(index.withColumn("shards", F.lit(shards)), "line-index")


def _arrays(row: dict) -> dict[str, np.ndarray]:
    return {"seeds": np.frombuffer(row["seeds"], np.uint32), "fingerprints": np.frombuffer(row["fingerprints"], np.uint64), "counts": np.frombuffer(row["counts"], np.int64), "extra": np.frombuffer(row["extra"], np.uint64).reshape(3, -1)}


def _counts(shard: dict[str, np.ndarray], hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    out = probe(shard, hi, lo)
    for h, l, c in shard["extra"].T:
        out[(hi == h) & (lo == l)] = c
    return out


def _lookup(index: dict, shards: int, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hi), np.int64)
    where = np.mod(hi.view(np.int64), shards)
    for s in np.unique(where):
        if s in index:
            rows = where == s
            out[rows] = _counts(index[s], hi[rows], lo[rows])
    return out


def _batch_lines(texts: list) -> tuple[list[list[bytes]], np.ndarray]:
    lines = [(t or b"").split(b"\n") for t in texts]
    known: dict[bytes, tuple[int, int]] = {b"": (0, 0)}
    flat = []
    for one in lines:
        for line in one:
            key = key_of(line)
            d = known.get(key)
            if d is None:
                d = known[key] = _digest(key)
            flat.append(d)
    return lines, np.array(flat, np.uint64).reshape(-1, 2)


def _probe_docs(index_of, shards: int, text_at: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of()
        for batch in parts(batches):
            lines, h = _batch_lines(batch.column(text_at).to_pylist())
            drop = _lookup(index, shards, h[:, 0].copy(), h[:, 1].copy()) > 0
            yield _kept(batch, text_at, lines, drop, schema)

    return run


def _kept(batch: pa.RecordBatch, text_at: int, lines: list, drop: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    texts, dropped, at = [], [], 0
    for one in lines:
        d = drop[at : at + len(one)]
        at += len(one)
        n = int(d.sum())
        dropped.append(n)
        texts.append(b"\n".join(one) if not n else b"\n".join(x for x, gone in zip(one, d.tolist()) if not gone))
    columns = [c for k, c in enumerate(batch.columns) if k != text_at]
    columns += [pa.array(texts, pa.binary()), pa.array([len(x) for x in lines], pa.int64()), pa.array(dropped, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _likely(sent, shards: int):
    """Lines that may be in the index, each with its text's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = sent.value
        for batch in parts(batches):
            lines, h = _batch_lines(batch.column(1).to_pylist())
            at = np.flatnonzero(bloom.has(h[:, 0].copy()))
            edge = np.cumsum([0, *map(len, lines)])
            row = np.searchsorted(edge, at, "right") - 1
            shard = np.mod(_signed(h[at, 0]), shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0).take(pa.array(row)), pa.array((at - edge[row]).astype(np.int32)), pa.array(_signed(h[at, 0])), pa.array(_signed(h[at, 1]))], ["shard", "_key", "line", "hi", "lo"])

    return run


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a shard and task: its arrays, then the lines that probe them."""
    index: dict = {}
    for batch in parts(batches, rows=100_000):
        shard, turn = (batch.column(c).to_numpy() for c in ("shard", "turn"))
        for k in np.flatnonzero(turn == 0).tolist():
            index[int(shard[k])] = _arrays(batch.column("index")[k].as_py())
        asked = batch.column("asked").filter(pa.array(turn == 1))
        hi, lo = (asked.field(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("hi", "lo"))
        own, hit = shard[turn == 1], np.zeros(len(hi), bool)
        for s in np.unique(own):
            rows = own == s
            hit[rows] = _counts(index[int(s)], hi[rows], lo[rows]) > 0
        index = {s: v for s, v in index.items() if s == shard[-1]}
        keep = pa.array(hit)
        yield pa.RecordBatch.from_arrays([asked.field("_key").filter(keep), asked.field("line").filter(keep)], ["_key", "line"])


def _drop_listed(text_at: int, hits_at: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            lines = [(t or b"").split(b"\n") for t in batch.column(text_at).to_pylist()]
            drop = np.zeros(sum(map(len, lines)), bool)
            at = 0
            for one, hit in zip(lines, batch.column(hits_at).to_pylist()):
                drop[[at + k for k in hit or []]] = True
                at += len(one)
            keep = [k for k in range(batch.num_columns) if k != hits_at]
            yield _kept(batch.select(keep), text_at - (hits_at < text_at), lines, drop, schema)

    return run


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with a column text -> its other columns, kept_text, n_lines, n_dropped, kept_sha256.

    Every line whose key has min_chars code points at least and is found in min_docs documents
    at least goes, in every document; the others stay, joined by newlines.
    """
    spark = docs.sparkSession
    keys, index = build_index(line_counts(docs, min_chars), min_docs)
    size = F.length("seeds") + F.length("fingerprints") + F.length("counts") + F.length("extra")
    total, shards = index.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max("shards"), F.lit(1))).first()

    others = [c for c in docs.columns if c not in ("text", *RESULTS)]
    source = docs.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(others)], F.col("text").cast("binary").alias("_text"))
    shape = T.StructType([*source.drop("_text").schema.fields, T.StructField("_text", T.BinaryType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    arrow = to_arrow_schema(shape)
    if total <= broadcast_bytes:
        value = spark.sparkContext.broadcast({r["shard"]: _arrays(r) for r in index.collect()})
        result = source.mapInArrow(_probe_docs(lambda: value.value, shards, len(others), arrow), shape)
    else:
        # rows are known by their content: copies of a row have the same lines to lose
        keyed = source.withColumn("_key", F.struct(F.xxhash64("_text").alias("a"), F.crc32(F.coalesce("_text", F.lit(b""))).alias("b"), F.coalesce(F.length("_text"), F.lit(0)).alias("n")))
        bloom = spark.sparkContext.broadcast(_bloom.build(keys.select("hi"), keys.count()))
        asked = staged(keyed.select("_key", "_text").mapInArrow(_likely(bloom, shards), "shard long, _key struct<a:bigint,b:bigint,n:int>, line int, hi long, lo long").distinct(), "likely-lines")
        bloom.unpersist()
        hits = beside(index.drop("shards"), asked, SERVED, "_key").mapInArrow(_hits, "_key struct<a:bigint,b:bigint,n:int>, line int")
        listed = hits.groupBy("_key").agg(F.collect_set("line").alias("_hits"))
        joined = keyed.join(listed, "_key", "left").select(*source.columns, "_hits")
        result = joined.mapInArrow(_drop_listed(len(others), len(others) + 1, arrow), shape)
    return result.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(others)], F.col("_text").cast("string").alias("kept_text"), "n_lines", "n_dropped", "kept_sha256")

