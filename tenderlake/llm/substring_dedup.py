"""Passages that occur more than once, found with prefix-partitioned suffix trees over words.

A window is `window` consecutive words of one document. A word goes if it is in a window whose words
also start anywhere else, in the same document or another.

1. Census of prefixes. Suffixes are sampled: every window contains `window - GRAM + 1` runs of GRAM
   words, and the one with the least hash is its anchor, a choice that depends on the window's words
   alone. The suffixes of all windows with one anchor begin by meeting under its GRAM words. Spark
   counts each prefix; a window whose prefix occurs once can't repeat. (All suffixes under their own
   first words would be fourteen times as many rows.)
2. Variable lengths. A prefix found more than HOT times is lengthened: its suffixes, one by one, meet
   under their own first LENGTHS[0] words, those still too many under LENGTHS[1], each after a census
   of its own, so no group outgrows a task, whatever the corpus. Bloom filters of fixed size say which
   prefixes occur twice (their errors cost rows, not results) and which are too frequent (an error
   lengthens a prefix, in all documents alike). What is still too frequent then is counted as whole
   windows, by Spark's aggregate, and needs no tree.
3. Dealing. Documents are read again. Neighbouring suffixes with the same anchor travel together, as
   the text they span, to the group of their prefix. Suffixes that repeat within a batch are settled
   there, and one of them travels for all.
4. Subtrees. A group's suffixes are split top-down by their next words, DEPTHS words at a time, and
   nodes with one suffix end. What is left at depth `window` are the deep internal nodes: their
   suffixes repeat, and starts that touch make up a maximal repeat. Tasks read groups in key order,
   GROUP_ROWS rows at a time.
5. Repeats go back to their documents by hashes of doc_id and text.

Words are compared by 64-bit hashes. Null or empty texts have no words, and texts of fewer words than
a window lose none. Rows that repeat are copies of each other, so all their windows repeat. Other
columns pass through; one that is named as a result gives way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _bloom
from ._stage import staged
from ._text import BLANK, Words, grams, mix, words_of
from ._worker import parts

GRAM = 8
HOT = 10_000
LENGTHS = (16, 24)
DEPTHS = (8, 8, 8, 8)
GROUP_ROWS = 50_000
RESULTS = ("kept_text", "n_words", "n_removed", "kept_sha256")
_Q = 0xD6E8FEB86659FD93
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums that give the hash of any range of words: (total[b] - total[a]) * inverse[a]."""
    if len(_powers[0]) <= len(h):
        for k, base in enumerate((_Q, pow(_Q, -1, 1 << 64))):
            x = np.full(max(2 * len(h), 1 << 18), base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers[0][: len(h)], out=total[1:])
    return total, _powers[1]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


@dataclass
class Runs:
    """Neighbouring window starts with one anchor."""

    doc: np.ndarray  # number in the column
    low: np.ndarray  # first start, as a word of the slice
    n: np.ndarray
    anchor: np.ndarray
    prefix: np.ndarray  # hash of the anchor's words


def runs_of(words: Words, hashes: np.ndarray, window: int) -> Runs:
    width = window - GRAM + 1
    n = len(hashes)
    if n < window:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none, none.astype(np.uint64))
    gram = grams(hashes, GRAM)
    bits = max(24, int(n).bit_length())
    place = np.uint64((1 << bits) - 1)
    least = sliding_min((gram & ~place) | np.arange(len(gram), dtype=np.uint64), width) & place
    doc_end = np.repeat(words.edge[1:], words.counts)
    start = np.flatnonzero(np.arange(n) + window <= doc_end)
    anchor = least[start].astype(np.int64)
    doc = np.repeat(np.arange(len(words.counts)), words.counts)[start]
    if not len(start):
        return Runs(doc, start, start, anchor, gram[:0])
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    return Runs(words.first + doc[new], start[new], np.diff(np.append(new, len(start))), anchor[new], gram[anchor[new]])


def _starts(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the place of each start in ranges of them."""
    row = np.repeat(np.arange(len(n)), n)
    return row, low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _prefix(total: np.ndarray, inverse: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hash of the first `length` words of suffixes."""
    return mix((total[start + length] - total[start]) * inverse[start] ^ np.uint64(length))


def _lengthened(hot: list, total: np.ndarray, inverse: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For suffixes whose anchor is too frequent: the prefix that each meets under, which of LENGTHS it has, and whether even the longest is too frequent. hot: filters of what is; the first is of anchors."""
    key, level, often = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int8), np.ones(len(start), bool)
    for k, length in enumerate(LENGTHS):
        key[often], level[often] = _prefix(total, inverse, start[often], length), k
        if k + 1 >= len(hot):
            return key, level, np.zeros(len(start), bool)
        often[often] = hot[k + 1].has(key[often])
    return key, level, often


WINDOWS = "hash long, weight long, sig long, did long, low int, n int"


def _frequent(sent, window: int, whole: bool):
    """Suffixes under anchors that are too frequent: counts of the prefixes they meet under; or (whole) the windows that are too frequent for any. Of a window found several times in a batch, one row with their number as weight is sent, and its places, in ranges, without a hash: they are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent.value
        for batch in parts(batches, rows=10_000, size=16 << 20):
            found = []
            places: list[tuple[np.ndarray, np.ndarray]] = []
            sig, did = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "did"))
            for w in words_of(batch.column("text")):
                h = w.hashes()
                runs = runs_of(w, h, window)
                many = hot[0].has(runs.prefix)
                if not many.any():
                    continue
                total, inverse = _sums(h)
                row, start = _starts(runs.low[many], runs.n[many])
                key, level, often = _lengthened(hot, total, inverse, start)
                if not whole:
                    found.append(key[level == len(hot) - 1])
                    continue
                doc, start = runs.doc[many][row][often], start[often]
                found.append(_prefix(total, inverse, start, window))
                places.append((doc, start - w.edge[doc - w.first]))
            if whole and found:
                each, first, back, count = np.unique(np.concatenate(found), return_index=True, return_inverse=True, return_counts=True)
                doc, low = (np.concatenate(x) for x in zip(*places))
                again = count[back] > 1
                d, b, m = _joined(doc[again], low[again], np.ones(int(again.sum()), np.int64))
                nothing = pa.nulls(len(d), pa.int64())
                yield pa.RecordBatch.from_arrays([nothing, nothing, pa.array(sig[d]), pa.array(did[d]), pa.array(b.astype(np.int32)), pa.array(m.astype(np.int32))], ["hash", "weight", "sig", "did", "low", "n"])
                doc, low = doc[first], low[first]
                yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(count), pa.array(sig[doc]), pa.array(did[doc]), pa.array(low.astype(np.int32)), pa.array(np.ones(len(low), np.int32))], ["hash", "weight", "sig", "did", "low", "n"])
            if not whole:
                prefix, n = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), pa.array(n.astype(np.int64))], ["prefix", "n"])

    return run


def _census(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [runs_of(w, w.hashes(), window).prefix for w in words_of(batch.column(0))]
            prefix, n = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), pa.array(n.astype(np.int64))], ["prefix", "n"])

    return run


TRAVEL = "key long, sig long, did long, low int, n int, twice boolean, words binary"
_TRAVEL = pa.schema([("key", pa.int64()), ("sig", pa.int64()), ("did", pa.int64()), ("low", pa.int32()), ("n", pa.int32()), ("twice", pa.bool_()), ("words", pa.binary())])


def _joined(doc: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts, those that touch put together."""
    order = np.lexsort((low, doc))
    doc, low, n = doc[order], low[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (low[1:] != low[:-1] + n[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[new], low[new], np.add.reduceat(n, new) if len(new) else n


def _deal(sent, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, hot = sent.value
        for batch in parts(batches, rows=10_000, size=16 << 20):
            slices: list[Words] = []
            found: list[list[np.ndarray]] = [[] for _ in range(8)]
            for k, w in enumerate(words_of(batch.column("text"))):
                h = w.hashes()
                runs = runs_of(w, h, window)
                keep = np.flatnonzero(bloom.has(runs.prefix))
                doc, low, n, anchor, key = (x[keep] for x in (runs.doc, runs.low, runs.n, runs.anchor, runs.prefix))
                total, inverse = _sums(h)
                many = hot[0].has(key) if hot else np.zeros(len(key), bool)
                if many.any():  # one suffix each, under its own first words
                    row, one = _starts(low[many], n[many])
                    longer, _, often = _lengthened(hot, total, inverse, one)
                    row, one, longer = np.flatnonzero(many)[row][~often], one[~often], longer[~often]  # the others are counted as whole windows
                    doc, low, n, anchor, key = (np.concatenate(x) for x in ((doc[~many], doc[row]), (low[~many], one), (n[~many], np.ones(len(row), np.int64)), (anchor[~many], anchor[row]), (key[~many], longer)))
                end = low + n + window - 1
                content = mix((total[end] - total[low]) * inverse[low]) ^ mix((n * window + anchor - low).astype(np.uint64) * np.uint64(_Q))
                for out, x in zip(found, (doc, low, n, key, content, np.full(len(low), k), end, low - w.edge[doc - w.first])):
                    out.append(x)
                slices.append(w)
            doc, low, n, key, content, of, end, begin = (np.concatenate([*x, np.zeros(0, np.int64)]) if i not in (3, 4) else np.concatenate([*x, np.zeros(0, np.uint64)]) for i, x in enumerate(found))
            _, first, inverse, count = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
            sig, did = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "did"))
            settled = count[inverse] > 1
            d, b, m = _joined(doc[settled], begin[settled], n[settled])
            if len(d):
                spread = mix(sig[d].view(np.uint64) + b.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(sig[d]), pa.array(did[d]), pa.array(b.astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(np.ones(len(d), bool)), pa.nulls(len(d), pa.binary())], schema=_TRAVEL)
            for part in np.array_split(first, max(1, len(first) // 20_000)):
                texts = [slices[s].buf[slices[s].start[a] : slices[s].end[e - 1]].tobytes() for s, a, e in zip(of[part].tolist(), low[part].tolist(), end[part].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(sig[doc[part]]), pa.array(did[doc[part]]), pa.array(begin[part].astype(np.int32)), pa.array(n[part].astype(np.int32)), pa.array(settled[part]), pa.array(texts, pa.binary())], schema=_TRAVEL)

    return run


def deep_nodes(group: np.ndarray, hashes: np.ndarray, start: np.ndarray, weight: np.ndarray, window: int) -> np.ndarray:
    """Which suffixes, given by their first words in hashes, share all `window` words with another of their group.

    The subtrees of all groups grow together from the root down: a node is split by its suffixes'
    next words; suffixes alone in their node (by weight) end there.
    """
    alive = np.arange(len(start))
    node = group
    total, inverse = _sums(hashes)
    depth = 0
    for step in (*DEPTHS, window - sum(DEPTHS)):
        at = start[alive] + depth
        following = (total[at + step] - total[at]) * inverse[at]
        _, inverse_of = np.unique(mix(mix(node.astype(np.uint64) + np.uint64(1)) + following), return_inverse=True)
        keep = np.bincount(inverse_of, weight[alive])[inverse_of] > 1 if len(alive) else np.zeros(0, bool)
        alive, node = alive[keep], inverse_of[keep]
        depth += step
    out = np.zeros(len(start), bool)
    out[alive] = True
    return out


REPEATS = "sig long, did long, low int, n int"
_REPEATS = pa.schema([("sig", pa.int64()), ("did", pa.int64()), ("low", pa.int32()), ("n", pa.int32())])


def _repeats(table: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    """Rows of whole groups, in key order."""
    passing = pc.is_null(table.column("words"))
    through = table.filter(passing).select(["sig", "did", "low", "n"]).combine_chunks()
    yield from through.to_batches()
    table = table.filter(pc.invert(passing)).combine_chunks()
    if not table.num_rows:
        return
    column = table.column("words").chunk(0)
    key, low, n = (table.column(c).to_numpy() for c in ("key", "low", "n"))
    twice = table.column("twice").to_numpy(zero_copy_only=False)
    hashes, edges, base = [], [np.zeros(1, np.int64)], 0
    for w in words_of(column):
        hashes.append(w.hashes())
        edges.append(base + w.edge[1:])
        base += len(hashes[-1])
    edge = np.concatenate(edges)
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    _, group = np.unique(key, return_inverse=True)
    deep = deep_nodes(group[row], np.concatenate(hashes), edge[row] + step, np.where(twice, 2, 1)[row], window)
    deep &= ~twice[row]  # settled where it came from
    r, b, m = _joined(row[deep], low[row[deep]] + step[deep], np.ones(int(deep.sum()), np.int64))
    take = pa.array(r)
    yield pa.RecordBatch.from_arrays([table.column("sig").chunk(0).take(take), table.column("did").chunk(0).take(take), pa.array(b.astype(np.int32)), pa.array(m.astype(np.int32))], schema=_REPEATS)


def _subtrees(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < GROUP_ROWS:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
            if cut:
                yield from _repeats(table.slice(0, cut), window)
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from _repeats(pa.Table.from_batches(held), window)

    return run


def repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """(sig, did, low, n): window starts low .. low + n - 1 of the document with those hashes repeat; docs has text, sig, did."""
    if window < sum(DEPTHS) + 1:
        raise ValueError(f"a window has more than {sum(DEPTHS)} words")
    spark = docs.sparkSession
    census = docs.select("text").mapInArrow(_census(window), "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
    twice = staged(census.where("n > 1"), "prefixes")
    hot: list[_bloom.Bloom] = []
    now = twice
    for level in range(len(LENGTHS) + 1):
        often = now.where(F.col("n") > HOT).select("prefix")
        if not (count := often.count()):
            break
        hot.append(_bloom.build(often, count))
        if level < len(LENGTHS):
            sent = spark.sparkContext.broadcast(hot)
            longer = docs.select("text", "sig", "did").mapInArrow(_frequent(sent, window, False), "prefix long, n long")
            now = staged(longer.groupBy("prefix").agg(F.sum("n").alias("n")), "longer-prefixes")
            sent.unpersist()
    sent = spark.sparkContext.broadcast((_bloom.build(twice.select("prefix"), twice.count()), hot))
    dealt = docs.select("text", "sig", "did").mapInArrow(_deal(sent, window), TRAVEL)
    found = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_subtrees(window), REPEATS)
    if len(hot) <= len(LENGTHS):
        return found
    whole = staged(docs.select("text", "sig", "did").mapInArrow(_frequent(spark.sparkContext.broadcast(hot), window, True), WINDOWS), "frequent-windows")
    place = ("sig", "did", "low", "n")
    again = whole.where("hash is not null").groupBy("hash").agg(F.sum("weight").alias("_n")).where("_n > 1").select("hash")
    return found.union(whole.where("hash is null").select(*place)).union(whole.where("weight = 1").join(again, "hash", "left_semi").select(*place))


def _remove(window: int, text_at: int, found_at: int, schema: pa.Schema):
    table = bytes(0x20 if b in BLANK else b for b in range(256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            total, removed, kept = [], [], []
            for text, found in zip(batch.column(text_at).to_pylist(), batch.column(found_at).to_pylist()):
                words = (text or b"").translate(table).split()
                n = len(words)
                if found:
                    edge = np.zeros(n + 1, np.int64)
                    for r in found:
                        edge[r["low"]] += 1
                        edge[r["low"] + r["n"] + window - 1] -= 1
                    stay = np.flatnonzero(np.cumsum(edge[:n]) == 0)
                    words = [words[i] for i in stay.tolist()]
                total.append(n)
                removed.append(n - len(words))
                kept.append(b" ".join(words))
            others = [c for k, c in enumerate(batch.columns) if k not in (text_at, found_at)]
            yield pa.RecordBatch.from_arrays([*others, pa.array(kept, pa.binary()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], schema=schema)

    return run


def dedup_substrings(docs: DataFrame, window: int = 35) -> DataFrame:
    """docs (doc_id, text, ...) -> its other columns, kept_text (kept words joined by a space), n_words, n_removed, kept_sha256."""
    others = [c for c in docs.columns if c not in ("text", *RESULTS)]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(others)], F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("sig"), F.xxhash64("doc_id").alias("did"))
    # copies of a row find the same repeats: a set of them is no longer than its text
    found = repeats(plain, window).groupBy("sig", "did").agg(F.collect_set(F.struct("low", "n")).alias("_found"))
    joined = plain.join(found, ["sig", "did"], "left").select(*[f"_c{k}" for k in range(len(others))], "text", "_found")
    shape = T.StructType([*joined.schema.fields[: len(others)], T.StructField("kept_text", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    out = joined.mapInArrow(_remove(window, len(others), len(others) + 1, to_arrow_schema(shape)), shape)
    return out.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(others)], F.col("kept_text").cast("string").alias("kept_text"), "n_words", "n_removed", "kept_sha256")
