"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The items' words (A-Z lower-cased, runs of digits, letters and non-ASCII characters) go into one
automaton, an item at a time. Documents' words stream through it; the state and the length of the
longest match so far say at each word whether a window of an item ends there.

An automaton holds SHARD_WORDS words at most (about 1 kB a word in a task). Up to that many, the one
automaton is broadcast and documents are read once. A larger benchmark is dealt to shards by item:

1. The hashes of all items' windows go into a Bloom filter of fixed size. One pass over the documents
   finds the windows that it lets through; a join on their hashes names the shards of each text.
2. The texts that have any, each once, travel to their shards, where an automaton is built and they
   stream through. A shard that many texts reach is served by several tasks.
3. Hits go back to the documents by the text's hashes.

So the corpus is read as often for a hundred shards as for two, and the driver holds no items then.

A window is `window` consecutive words of an item; an item with fewer words, but not none, is one
window. Null or empty texts and items have no words. Items that repeat count once for each item_id;
those without an item_id make words hit as others do, and add no name.
Rows of documents that repeat are judged alike. Other columns pass through; from find_overlaps, one
that is named as a result gives way to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _bloom
from ._serve import beside
from ._stage import staged
from ._text import ALNUM, grams, mix, words_of
from ._worker import keep, parts

SHARD_WORDS = 100_000
#: Texts that one task scans for a shard, about.
SERVED = 20_000

#: Bytes that end a word become blanks, A-Z become a-z.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if ALNUM[b] else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several items; states are numbers, 0 the root."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, item in items:
            last = 0
            for word in item:
                last = self._add(last, word)
        self.items: list[set[str | None]] = [set() for _ in self.next]  # of states of `window` words: the items they occur in
        self.short: dict[int, list[tuple[int, str | None]]] = {}  # state -> (words, item) of items shorter than a window
        for name, item in items:
            if 0 < len(item) < window:
                state = 0
                for word in item:
                    state = self.next[state][word]
                self.short.setdefault(state, []).append((len(item), name))
            state = 0
            for word in item:
                state = self.next[state][word]
                at = state
                while at > 0 and self.length[at] >= window and name not in self.items[at]:
                    self.items[at].add(name)
                    at = self.link[at]
        self._ends_short: dict[int, list[tuple[int, str | None]]] = {}
        if self.short:
            for state in range(len(self.next)):
                found, at = [], state
                while at > 0:
                    found += self.short.get(at, [])
                    at = self.link[at]
                if found:
                    self._ends_short[state] = found

    def _add(self, last: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:  # known from an earlier item
            q = nxt[last][word]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, word, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        return clone

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words, in order and apart, and the items whose windows occur."""
        nxt, link, length, window, ends_short = self.next, self.link, self.length, self.window, self._ends_short
        spans: list[list[int]] = []
        found: set[str | None] = set()
        state = matched = 0
        for i, word in enumerate(text):
            to = nxt[state].get(word)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = nxt[state].get(word)
                matched = length[state]
                if to is None:
                    continue
            state = to
            matched += 1
            reach = 0
            if matched >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                found |= self.items[at]
                reach = matched
            elif state in ends_short:
                for n, name in ends_short[state]:
                    if n <= matched:
                        found.add(name)
                        reach = max(reach, n)
            if matched >= window and state in ends_short:
                found.update(name for n, name in ends_short[state] if n <= matched)
            if reach:
                begin = i + 1 - reach
                while spans and spans[-1][0] >= begin:
                    spans.pop()
                if spans and spans[-1][1] >= begin:
                    spans[-1][1] = i + 1
                else:
                    spans.append([begin, i + 1])
        return [(a, b) for a, b in spans], found - {None}


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
Found = list[tuple[int, list[tuple[int, int]], list[str]]]


def _with_spans(batch: pa.RecordBatch, found: Found, schema: pa.Schema) -> pa.RecordBatch:
    spans = pa.array([[{"start": a, "end": b} for a, b in at] for _, at, _ in found], _SPANS)
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array([n for n, _, _ in found], pa.int64()), spans, pa.array([x for _, _, x in found], pa.list_(pa.string()))], schema=schema)


def _cut(text: bytes | None, spans: list[tuple[int, int]]) -> bytes | None:
    """The text without the bytes from each span's first word to its last; what blanks stood before stay."""
    if not spans or text is None:
        return text
    inside = ALNUM[np.frombuffer(text.translate(_TABLE), np.uint8)]
    start = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    end = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : start[a]])
        at = int(end[b - 1])
    return b"".join([*out, text[at:]])


def _without_spans(max_span: int, max_coverage: float) -> Callable[[pa.RecordBatch, Found, pa.Schema], pa.RecordBatch]:
    def finish(batch: pa.RecordBatch, found: Found, schema: pa.Schema) -> pa.RecordBatch:
        stay = [k for k, (n, at, _) in enumerate(found) if sum(b - a for a, b in at) <= max_coverage * max(n, 1)]
        kept = batch.take(pa.array(stay, pa.int64()))
        texts = [_cut(t, [(a, b) for a, b in found[k][1] if b - a > max_span]) for k, t in zip(stay, kept.column("_text").to_pylist())]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()) if n == "_text" else c for n, c in zip(batch.schema.names, kept.columns)], schema=schema)

    return finish


def _scanner(automaton_of: Callable[[], Automaton], finish, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of()
        for batch in parts(batches):
            found = []
            for text in batch.column("_text"):
                own = words(text.as_py())
                spans, items = automaton.scan(own)
                found.append((len(own), spans, sorted(items)))
            yield finish(batch, found, schema)

    return run


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order and apart."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _told(finish, schema: pa.Schema):
    """As _scanner, with the hits that shards found, in the last two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            spans, items = (batch.column(c).to_pylist() for c in ("_spans", "_items"))
            counts = [len(words(t)) for t in batch.column("_text").to_pylist()]
            found = [(n, _united([(s["start"], s["end"]) for s in at or []]), sorted(set(own or []))) for n, at, own in zip(counts, spans, items)]
            yield finish(batch.select([n for n in batch.schema.names if n not in ("_spans", "_items")]), found, schema)

    return run


def _windows(column: pa.Array, sizes: list[int], whole: bool, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, hash, words) of the windows of a column's texts; whole: a text of fewer words than a window is one, else all runs of `sizes` words are given."""
    for w in words_of(column, ALNUM, lower=True):
        h = w.hashes()
        doc = np.repeat(np.arange(len(w.counts)), w.counts)
        left = np.repeat(w.edge[1:], w.counts) - np.arange(len(h))  # words from each to its text's end
        n = w.counts[doc]
        for k in sizes:
            g = grams(h, k)
            good = left[: len(g)] >= k
            if whole and k < window:
                good &= (n[: len(g)] == k) & (left[: len(g)] == k)
            at = np.flatnonzero(good)
            yield w.first + doc[at], mix(g[at] ^ np.uint64(k)), np.full(len(at), k)


def _item_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for doc, h, k in _windows(batch.column(1), [*range(1, window + 1)], True, window):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(h.view(np.int64)), pa.array(k, pa.int32())], ["shard", "hash", "k"])

    return run


def _candidates(sent, sizes: list[int], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = sent.value
        for batch in parts(batches):
            for doc, h, _ in _windows(batch.column(1), sizes, False, window):
                hit = bloom.has(h)
                pair = np.unique(np.stack([doc[hit], h[hit].view(np.int64)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pair[:, 0])), pa.array(pair[:, 1])], ["_key", "hash"])

    return run


_SERVE = pa.schema([("_key", pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32())])), ("_spans", _SPANS), ("_items", pa.list_(pa.string()))])


def _serve(window: int):
    """Rows of a shard and task: its items, then the texts that stream through their automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, items, automaton = None, [], None
        for batch in parts(batches):
            keys, spans, names = [], [], []
            for r in batch.to_pylist():
                if (r["shard"], r["salt"]) != own:
                    own, items, automaton = (r["shard"], r["salt"]), [], None
                if not r["turn"]:
                    items.append((r["index"]["item_id"], words(r["index"]["text"])))
                    continue
                automaton = automaton or Automaton(items, window)
                at, found = automaton.scan(words(r["asked"]["_text"]))
                if at:
                    keys.append(r["asked"]["_key"])
                    spans.append([{"start": a, "end": b} for a, b in at])
                    names.append(sorted(found))
            yield pa.RecordBatch.from_arrays([pa.array(keys, _SERVE.field(0).type), pa.array(spans, _SPANS), pa.array(names, pa.list_(pa.string()))], schema=_SERVE)

    return run


def _key(text: Column) -> Column:
    """Of a row's content: copies of a text have the same hits."""
    return F.struct(F.xxhash64(text).alias("a"), F.crc32(F.coalesce(text, F.lit(b""))).alias("b"), F.coalesce(F.length(text), F.lit(0)).alias("n"))


def _hits_of_shards(texts: DataFrame, named: DataFrame, window: int, shards: int) -> DataFrame:
    """texts (_key, _text), items (item_id, text) -> _key, _spans and _items of the texts with hits."""
    spark = texts.sparkSession
    # items without a name are dealt by their texts
    dealt = named.withColumn("shard", F.pmod(F.xxhash64(F.coalesce(F.col("item_id").cast("binary"), F.col("text"))), F.lit(shards)))
    windows = staged(dealt.select("shard", "text").mapInArrow(_item_windows(window), "shard long, hash long, k int").distinct(), "item-windows")
    sizes = sorted(r["k"] for r in windows.select("k").distinct().collect())  # `window` of them at most
    bloom = spark.sparkContext.broadcast(_bloom.build(windows.select("hash").distinct(), windows.count()))
    kind = texts.schema["_key"].dataType.simpleString()
    near = texts.mapInArrow(_candidates(bloom, sizes, window), f"_key {kind}, hash long").distinct()
    routes = staged(near.join(windows, "hash").select("_key", "shard").distinct(), "text-shards")
    bloom.unpersist()
    once = texts.join(routes.select("_key").distinct(), "_key", "left_semi").groupBy("_key").agg(F.first("_text").alias("_text"))
    rows = beside(dealt, once.join(routes, "_key"), SERVED, "_key")
    found = rows.mapInArrow(_serve(window), f"_key {kind}, _spans array<struct<start:bigint,end:bigint>>, _items array<string>")
    return found.groupBy("_key").agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.flatten(F.collect_list("_items")).alias("_items"))


def _scanned(plain: DataFrame, items: DataFrame, window: int, shard_words: int, finish, shape: T.StructType) -> DataFrame:
    """plain, with a binary column _text, through finish, which is given each text's words, spans and items."""
    spark = plain.sparkSession
    named = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    total = named.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0  # words at most
    schema = to_arrow_schema(shape)
    if total > shard_words:
        keyed = plain.withColumn("_key", _key(F.col("_text")))
        hits = _hits_of_shards(keyed.select("_key", "_text"), named, window, int(-(-total // shard_words)))
        return keyed.join(hits, "_key", "left").drop("_key").mapInArrow(_told(finish, schema), shape)
    held = sorted(((r.item_id, words(bytes(r.text))) for r in named.toLocalIterator()), key=lambda item: (item[0] is None, item[0] or "", item[1]))
    value = spark.sparkContext.broadcast((held, window))
    number = value._jbroadcast.id()  # each worker builds the automaton once
    return plain.mapInArrow(_scanner(lambda: keep(("automaton", number), lambda: Automaton(*value.value)), finish, schema), shape)


def find_overlaps(docs: DataFrame, items: DataFrame, window: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs with a column text, items (item_id, text) -> docs, n_words, spans of hit word numbers, items with occurring windows."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "spans", "items")])
    plain = docs.select(*[F.col(f"`{c}`").cast("binary").alias("_text") if c == "text" else F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(docs.columns)])
    shape = T.StructType([*plain.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    found = _scanned(plain, items, window, shard_words, _with_spans, shape)
    names = [F.col("_text").cast("string").alias(c) if c == "text" else F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)]
    return found.select(*names, "n_words", "spans", "items")


def hit_words(spans: str = "spans"):
    """Words in a column of spans."""
    return F.aggregate(F.transform(spans, lambda s: s["end"] - s["start"]), F.lit(0).cast("long"), lambda a, x: a + x)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_span: int = 0, max_coverage: float = 0.5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs without benchmark passages: spans of more than max_span words are cut out of text, and documents of which hits cover more than max_coverage of the words go."""
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(docs.columns) if c != "text"])
    plain = docs.select(row.alias("row"), F.col("text").cast("binary").alias("_text"))
    cut = _scanned(plain, items, window, shard_words, _without_spans(max_span, max_coverage), plain.schema)
    return cut.select(*[(F.col("_text").cast("string") if c == "text" else F.col(f"row._c{k}")).alias(c) for k, c in enumerate(docs.columns)])


def report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    found = find_overlaps(docs.select("doc_id", "text"), items, window)
    return found.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
