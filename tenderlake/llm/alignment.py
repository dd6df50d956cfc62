"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids are linked.

Over space+text, byte offsets at which a token of A and one of B both end are cuts; between two cuts
lies a group, and each of its A tokens is linked to each of its B tokens.

What a byte range of a text holds is a fragment: an open prefix (tokens up to its first cut, whose
group may begin before it), closed groups, and an open suffix (tokens after its last cut). Fragments
compose: suffix and prefix that meet close a group, or, without a cut, stay open. Composition is
associative, so texts of over LONG bytes are cut into byte ranges that Spark's tasks take apart, and
their fragments are composed by a tree, FAN at a time. Shorter texts stay in their row: each space
or newline between two printable ASCII characters is a border of both tokenizers, the segment from one to the
next is a fragment that is closed on both sides, each distinct one is encoded once, and composing
them is concatenation, with numpy, for many documents at once. Long texts are encoded in pieces that
end at such borders, UNIT bytes or more; a run without one is encoded in one task, as it must be.

Ids are those of the two libraries for the whole text; strings of special tokens in it are plain
text. A text that is null or empty, or that a tokenizer's token bytes don't give back, has no tokens:
zeros and ''. Rows that share a doc_id, or have none, are documents of their own; doc_id keeps its
type. Other columns aren't read. Of a document, tokens and groups are held in one task at the end of
the tree, as its text was in one row.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import shared_dir, staged
from ._text import Words, buffer_of
from ._tokens import Encoder
from ._worker import keep, parts, release

LONG = 1 << 16
UNIT = 1 << 15
#: Bytes of the ranges of which a long text's fragments are made.
RANGE = 1 << 14
FAN = 8
SLICE = 1 << 20
#: Segments that a worker keeps, and bytes of new ones that it encodes as one text.
KEPT = 110_000
AT_ONCE = 1_500
#: Pairs that are broadcast with their counts: the most frequent ones.
BROADCAST_PAIRS = 4_000_000
HELD_PAIRS = 1_000_000
#: Links of a group up to which each is written out.
_FEW = 1 << 10
_B_BITS, _PAIR_BITS = 20, 40

_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[0x21:0x7F] = True


@dataclass
class Fragment:
    """Tokens of a byte range: ids of A and B before its first cut; ids and sizes of the groups between cuts; ids after its last cut. Without a cut all are before."""

    before: tuple[np.ndarray, np.ndarray]
    cut: bool
    closed: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    after: tuple[np.ndarray, np.ndarray]


_NO_IDS = np.zeros(0, np.uint32)


def fragment(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Fragment:
    """Of the tokens that end in a range, by the offsets at which they end."""
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    if not len(cuts):
        return Fragment((a, b), False, (_NO_IDS,) * 4, (_NO_IDS,) * 2)
    at, bt = (np.searchsorted(ends, cuts, "right") for ends in (a_ends, b_ends))
    sizes = [np.diff(x).astype(np.uint32) for x in (at, bt)]
    return Fragment((a[: at[0]], b[: bt[0]]), True, (a[at[0] : at[-1]], b[bt[0] : bt[-1]], *sizes), (a[at[-1] :], b[bt[-1] :]))


def compose(x: Fragment, y: Fragment) -> Fragment:
    both = lambda p, q: tuple(np.concatenate(z) for z in zip(p, q))
    if not x.cut:
        return Fragment(both(x.before, y.before), y.cut, y.closed, y.after)
    met = both(x.after, y.before)
    if not y.cut:
        return Fragment(x.before, True, x.closed, met)
    group = (*met, *(np.array([len(z)], np.uint32) for z in met))
    return Fragment(x.before, True, tuple(np.concatenate(z) for z in zip(x.closed, group, y.closed)), y.after)


def whole(x: Fragment) -> tuple[np.ndarray, ...] | None:
    """(a, b, sizes of A, sizes of B) of a document; None if it doesn't end at a cut."""
    edge = (np.zeros(0, np.uint32),) * 2
    done = compose(Fragment(edge, True, (_NO_IDS,) * 4, edge), x)
    return done.closed if not len(done.after[0]) and not len(done.after[1]) else None


class _Bytes:
    """The bytes of each id of a vocabulary."""

    def __init__(self, each: list[bytes]):
        self.length = np.array([*map(len, each)], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(each), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        to = np.cumsum(n)
        return self.flat[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(self.start[ids] - (to - n), n)].tobytes()


class Aligner:
    """Both tokenizers of a worker, and the segments that it met last."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = Encoder(a_path)
        self.a.whole.encode_special_tokens = True
        self.a.added = None
        letters = {c: b for b, c in enumerate(self.a.letters)}
        a_bytes = [bytes(letters.get(c, 0x20) for c in self.a.whole.id_to_token(i) or "") for i in range(self.a.vocabulary)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        b_bytes = [piece(i) for i in range(self.b.get_piece_size())]
        self.tables = _Bytes(a_bytes), _Bytes(b_bytes)
        self.blank = self.b.piece_to_id("▁")
        # a space is a border of B if no piece has one behind another character, a newline if it is in no piece but a byte's, and if nothing is rewritten before
        probe = "a  bc\n d \tﬁ² Ａ."
        plain = all(" " not in x.lstrip(b" ").decode("utf-8", "replace") for x in b_bytes) and not any(b"\n" in x and len(x) > 1 for x in b_bytes) and self.b.decode(self.b.encode(probe)) == probe
        self.borders = plain and self.a.pattern is not None and not self.a.lower
        # what isn't asked for again while KEPT others come goes
        self.kept: dict[bytes, tuple] = {}
        self.before: dict[bytes, tuple] = {}

    def tokens(self, segment: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B of what begins with a space, or else at a border; None if a tokenizer loses bytes."""
        a = self.a.whole.encode(segment.decode(), add_special_tokens=False).ids
        if segment.startswith(b" "):
            b = self.b.encode(segment[1:].decode(), num_threads=1) or [self.blank]
        else:  # B adds a space, which stays by itself
            b = self.b.encode(segment.decode(), num_threads=1)[1:]
        ids = tuple(np.array(x, np.uint32) for x in (a, b))
        return ids if all(table.bytes_of(x) == segment for table, x in zip(self.tables, ids)) else None

    def ends(self, ids: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """The offsets at which tokens end."""
        return [np.cumsum(table.length[x]) for table, x in zip(self.tables, ids)]

    def _entries(self, ids: tuple[np.ndarray, np.ndarray], edges: np.ndarray) -> list[tuple] | None:
        """Ids and group sizes, as bytes, of segments that end at the offsets edges[1:]; None if one of these is no cut."""
        a_ends, b_ends = self.ends(ids)
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        at = np.searchsorted(cuts, edges[1:])
        if not len(cuts) or at[-1] >= len(cuts) or (cuts[at] != edges[1:]).any():
            return None
        places = [np.searchsorted(e, cuts) + 1 for e in (a_ends, b_ends)]
        sizes = [np.diff(x, prepend=0).astype(np.uint32) for x in places]
        group_edge = np.append(0, at + 1)
        fields = []
        for flat, edge in [*((x, np.append(0, p)[group_edge]) for x, p in zip(ids, places)), *((x, group_edge) for x in sizes)]:
            raw, edge = flat.tobytes(), (4 * edge).tolist()
            fields.append([raw[i:j] for i, j in zip(edge, edge[1:])])
        return [*zip(*fields)]

    def _several(self, segments: list[bytes]) -> list[tuple | None]:
        """Segments that begin at a border and end before one, encoded as one text; one by one if that isn't what they give together."""
        text, edges = b"".join(segments), np.cumsum([0, *map(len, segments)])
        ids = self.tokens(text)
        found = self._entries(ids, edges) if ids is not None else None
        if found is None and len(segments) > 1:
            half = len(segments) // 2
            return self._several(segments[:half]) + self._several(segments[half:])
        return found if found is not None else [None]

    def align(self, segments: list[bytes]) -> list[tuple | None]:
        """Ids of A and B and the groups' sizes, as bytes, of each segment; None for one whose bytes are lost."""
        made: dict[bytes, tuple | None] = {}
        there = {s: x for s in segments if (x := self.kept.get(s) or self.before.get(s))}
        new = [s for s in segments if s not in there]
        plain = [s for s in new if self.borders and len(s) > 1 and s[0] in b" \n" and _GRAPHIC[s[1]] and _GRAPHIC[s[-1]]]
        batch, size = [], 0
        for s in plain:
            batch.append(s)
            size += len(s)
            if size > AT_ONCE:
                made.update(zip(batch, self._several(batch)))
                batch, size = [], 0
        if batch:
            made.update(zip(batch, self._several(batch)))
        for s in new:
            if s not in made:
                ids = self.tokens(s)
                made[s] = self._entries(ids, np.array([0, len(s)]))[0] if ids is not None else None
        there.update(made)
        self.kept.update((s, x) for s, x in there.items() if x and len(s) < 64)
        if len(self.kept) > KEPT:
            self.kept, self.before = {}, self.kept
        return [there[s] for s in segments]

    def borders_of(self, buf: np.ndarray) -> np.ndarray:
        """Offsets of the spaces and newlines, between printable characters, that both tokenizers begin a token at."""
        if not self.borders or len(buf) < 3:
            return np.zeros(0, np.int64)
        return np.flatnonzero(((buf[1:-1] == 0x20) | (buf[1:-1] == 0x0A)) & _GRAPHIC[buf[:-2]] & _GRAPHIC[buf[2:]]) + 1


def aligner(a_path: str, b_path: str) -> Aligner:
    return keep(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))


@dataclass
class Aligned:
    """Tokens and groups of some documents, one after the other; edges: n + 1 offsets of each document."""

    a: np.ndarray
    b: np.ndarray
    na: np.ndarray
    nb: np.ndarray
    a_edge: np.ndarray
    b_edge: np.ndarray
    g_edge: np.ndarray

    def columns(self) -> list[pa.Array]:
        """size, a, b, groups as kept in tables: ids in 2 bytes where they fit, sizes in 1; then n_a, n_b, n_groups, n_links, groups_sha256."""
        narrow = lambda x, kinds: next(k for k in kinds if not len(x) or x.max() <= np.iinfo(k).max)
        wide = np.dtype(max(narrow(self.a, ("<u2", "<u4")), narrow(self.b, ("<u2", "<u4"))))
        sizes = np.dtype(max(narrow(self.na, ("u1", "<u4")), narrow(self.nb, ("u1", "<u4")), key=lambda k: np.dtype(k).itemsize))
        pairs = np.stack([self.na, self.nb], 1)
        cut = lambda x, edge, kind: pa.array([(x[i:j].astype(kind)).tobytes() for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.binary())
        n = len(self.a_edge) - 1
        total = np.append(0, np.cumsum(self.na.astype(np.int64) * self.nb))
        return [
            pa.array(np.full(n, wide.itemsize * 8 + sizes.itemsize, np.int32)),
            cut(self.a, self.a_edge, wide),
            cut(self.b, self.b_edge, wide),
            cut(pairs, self.g_edge, sizes),
            *[pa.array(np.diff(x)) for x in (self.a_edge, self.b_edge, self.g_edge)],
            pa.array(np.diff(total[self.g_edge])),
            pa.array(self.digests()),
        ]

    def digests(self) -> list[str]:
        """sha256 of each document's groups as `a1,a2|b1;a3|b2,b3`; '' without any."""
        na, nb = self.na.astype(np.int64), self.nb.astype(np.int64)
        start = np.cumsum(na + nb) - (na + nb)
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        ids[np.repeat(start - (np.cumsum(na) - na), na) + np.arange(len(self.a))] = self.a
        ids[np.repeat(start + na - (np.cumsum(nb) - nb), nb) + np.arange(len(self.b))] = self.b
        sep = np.full(len(ids), ord(","), np.uint8)
        sep[start + na - 1], sep[start + na + nb - 1] = ord("|"), ord(";")
        digits, width = _decimals(int(ids.max(initial=1)).bit_length())
        table, n = digits[ids], width[ids]
        table[np.arange(len(ids)), n] = sep
        raw = table[np.arange(table.shape[1]) <= n[:, None]].tobytes()
        edge = np.append(0, np.cumsum(n + 1))[self.a_edge + self.b_edge].tolist()
        return [hashlib.sha256(raw[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(edge[:-1], edge[1:])]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, times) of all links: one row for each, but for groups of many links, whose equal ones are put together. pair: A id << 20 | B id."""
        na, nb = self.na.astype(np.int64), self.nb.astype(np.int64)
        a_at, b_at, n = np.cumsum(na) - na, np.cumsum(nb) - nb, na * nb
        doc = np.repeat(np.arange(len(self.g_edge) - 1), np.diff(self.g_edge))
        few = np.flatnonzero(n <= _FEW)
        of = np.repeat(few, n[few])
        k = np.arange(len(of)) - np.repeat(np.cumsum(n[few]) - n[few], n[few])
        found = [(doc[of], self.a[a_at[of] + k // nb[of]].astype(np.int64) << _B_BITS | self.b[b_at[of] + k % nb[of]], np.ones(len(of), np.int64))]
        for g in np.flatnonzero(n > _FEW).tolist():
            (x, xn), (y, yn) = (np.unique(v[i : i + m].astype(np.int64), return_counts=True) for v, i, m in ((self.a, a_at[g], na[g]), (self.b, b_at[g], nb[g])))
            found.append((np.full(len(x) * len(y), doc[g]), (x[:, None] << _B_BITS | y).ravel(), (xn[:, None] * yn).ravel()))
        return tuple(np.concatenate(z) for z in zip(*found))


@lru_cache
def _decimals(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of numbers below 2 ** bits, with a place behind, and how many they have."""
    n = np.arange(1 << bits)
    width = np.maximum(1, np.ceil(np.log10(n + 1 - 1e-9))).astype(np.int64)
    place = width[:, None] - 1 - np.arange(8)
    return (n[:, None] // 10 ** np.maximum(place, 0) % 10 + ord("0")).astype(np.uint8), width


def _together(entries: list[tuple | None], of: np.ndarray, edge: np.ndarray) -> Aligned:
    """Documents out of segments: of: the entry of each segment, edge: n + 1 offsets of documents in it. A document with an entry None has no tokens."""
    lost = np.array([x is None for x in entries], bool)
    bad = np.append(0, np.cumsum(lost[of]))[edge]
    counts = np.where(np.diff(bad) == 0, np.diff(edge), 0)
    of = of[np.repeat(np.diff(bad) == 0, np.diff(edge))]
    segment_edge = np.append(0, np.cumsum(counts))
    flats, edges = [], []
    for field in range(4):
        raw = [b"" if x is None else x[field] for x in entries]
        length = np.array([len(x) // 4 for x in raw], np.int64)
        begin = np.cumsum(length) - length
        n = length[of]
        to = np.cumsum(n)
        flats.append(np.frombuffer(b"".join(raw), np.uint32)[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(begin[of] - (to - n), n)])
        edges.append(np.append(0, to)[segment_edge])
    return Aligned(*flats, edges[0], edges[1], edges[2])


def align_texts(tool: Aligner, texts: pa.Array) -> Aligned:
    """Of a string column."""
    spaced = pc.binary_join_element_wise(pa.scalar(" "), pc.fill_null(texts, ""), "")
    buf, at = buffer_of(spaced)
    used = np.diff(at) > 1
    starts = np.union1d(tool.borders_of(buf), at[:-1])
    ends = np.append(starts[1:], len(buf))
    edge = np.searchsorted(starts, at)
    words = Words(0, buf, starts, ends, np.diff(edge), edge, at)
    keep_segment = np.repeat(used, np.diff(edge))
    starts, ends = starts[keep_segment], ends[keep_segment]
    _, first, of = np.unique(words.hashes(starts, ends), return_index=True, return_inverse=True)
    raw = buf.tobytes()
    entries = tool.align([raw[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist())])
    return _together(entries, of, np.append(0, np.cumsum(np.where(used, np.diff(edge), 0))))


_SHAPE = "size int, a binary, b binary, groups binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_NAMES = [x.split()[0] for x in _SHAPE.split(", ")]


def _align_short(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        for batch in parts(batches, size=SLICE):
            yield pa.RecordBatch.from_arrays([batch.column(0), *align_texts(tool, batch.column(1)).columns()], ["doc_id", *_NAMES])

    return run


def _units(a_path: str, b_path: str, unit: int):
    """Pieces of a text between borders, in order, with their first byte in space+text; each begins with a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, rows=1):
            tool = aligner(a_path, b_path)
            raw = b" " + batch.column(1)[0].as_py().encode()
            borders, cuts = tool.borders_of(np.frombuffer(raw, np.uint8)), [0]
            while (k := np.searchsorted(borders, cuts[-1] + unit)) < len(borders):
                cuts.append(int(borders[k]))
            pieces = [raw[i:j] for i, j in zip(cuts, [*cuts[1:], len(raw)])]
            n = len(cuts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([0] * n)), pa.array(cuts, pa.int64()), pa.array(pieces, pa.binary())], ["row", "at", "piece"])
        release()

    return run


_PARTS = "ok boolean, cut boolean, a0 binary, b0 binary, a binary, b binary, na binary, nb binary, a1 binary, b1 binary"


def _fragment_columns(found: list[Fragment | None]) -> list[pa.Array]:
    flat = [None if x is None else (*x.before, *x.closed, *x.after) for x in found]
    binary = [pa.array([b"" if x is None else np.asarray(x[k], np.uint32).tobytes() for x in flat], pa.binary()) for k in range(8)]
    return [pa.array([x is not None for x in found]), pa.array([x is not None and x.cut for x in found]), *binary]


def _fragments_of(table: pa.Table | pa.RecordBatch) -> list[Fragment | None]:
    ids = lambda name, k: np.frombuffer(table.column(name)[k].as_py(), np.uint32)
    ok, cut = table.column("ok").to_pylist(), table.column("cut").to_pylist()
    get = lambda k, *names: tuple(ids(x, k) for x in names)
    return [Fragment(get(k, "a0", "b0"), cut[k], get(k, "a", "b", "na", "nb"), get(k, "a1", "b1")) if ok[k] else None for k in range(table.num_rows)]


def _fragments(a_path: str, b_path: str, width: int):
    """The fragments of a piece: one for each range of `width` bytes of the document that it reaches into, in order (seq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, rows=8):
            tool = aligner(a_path, b_path)
            rows, seq, found = [], [], []
            for row, at, piece in zip(*(c.to_pylist() for c in batch.columns)):
                ids, own = tool.tokens(piece), [None]
                if ids is not None:
                    ends = [at + e for e in tool.ends(ids)]
                    edges = np.arange(at // width, (at + len(piece) - 1) // width + 2) * width
                    a, b = (np.searchsorted(e, edges, "right") for e in ends)
                    a[-1], b[-1] = len(ids[0]), len(ids[1])
                    own = [fragment(ids[0][a[k] : a[k + 1]], ends[0][a[k] : a[k + 1]], ids[1][b[k] : b[k + 1]], ends[1][b[k] : b[k + 1]]) for k in range(len(edges) - 1)]
                rows += [row] * len(own)
                # a range that two pieces share has a fragment of each: the later piece's has the larger number
                seq += [at + k for k in range(len(own))]
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(seq, pa.int64()), *_fragment_columns(found)], ["row", "seq", *[x.split()[0] for x in _PARTS.split(", ")]])
        release()

    return run


def _composed(table: pa.Table) -> pa.Table:
    """Neighbours of one document as one fragment."""
    table = table.sort_by("seq")
    found = _fragments_of(table)
    one = None if any(x is None for x in found) else found[0]
    for x in found[1:] if one is not None else []:
        one = compose(one, x)
    return pa.Table.from_arrays([table.column("row")[:1], table.column("part")[:1], *_fragment_columns([one])], ["row", "seq", *[x.split()[0] for x in _PARTS.split(", ")]])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's only fragment, closed by its two ends."""
    for batch in parts(batches, rows=1):
        x = _fragments_of(batch)[0]
        done = whole(x) if x is not None else None
        a, b, na, nb = done if done is not None else (_NO_IDS,) * 4
        edges = [np.array([0, len(z)]) for z in (a, b, na)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *Aligned(a, b, na, nb, *edges).columns()], ["row", *_NAMES])


def align_long(docs: DataFrame, a_path: str, b_path: str, unit: int = UNIT, width: int = RANGE, fan: int = FAN) -> DataFrame:
    """docs (doc_id, text, no nulls) -> doc_id and the columns of align(), by fragments over many tasks."""
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "long-texts")
    pieces = staged(rows.select("row", "text").mapInArrow(_units(a_path, b_path, unit), "row long, at long, piece binary"), "long-pieces")
    tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    made = staged(pieces.repartition(tasks, "row", "at").mapInArrow(_fragments(a_path, b_path, width), f"row long, seq long, {_PARTS}"), "fragments")
    numbers = made.groupBy("row").agg(F.array_sort(F.collect_list("seq")).alias("all")).select("row", F.posexplode("all").alias("place", "seq"))
    left = made.join(numbers, ["row", "seq"]).withColumn("seq", F.col("place").cast("long")).drop("place")
    most = numbers.agg(F.max("place")).first()[0] or 0
    while most > 0:  # as many rounds as the longest text's levels
        left = left.withColumn("part", F.floor(F.col("seq") / fan)).groupBy("row", "part").applyInArrow(_composed, f"row long, seq long, {_PARTS}")
        most //= fan
    return rows.select("row", "doc_id").join(left.mapInArrow(_finished, f"row long, {_SHAPE}"), "row").drop("row")


def align(docs: DataFrame, a_path: str, b_path: str, long: int = LONG, unit: int = UNIT, width: int = RANGE, fan: int = FAN) -> DataFrame:
    """docs (doc_id, text) -> doc_id, row, size, a, b, groups (ids and group sizes, see Aligned.columns), n_a, n_b, n_groups, n_links, groups_sha256; written in the shared folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    beyond = F.coalesce(F.octet_length("text") > long, F.lit(False))
    short = docs.where(~beyond).select("doc_id", "text").mapInArrow(_align_short(a_path, b_path), f"doc_id {kind}, {_SHAPE}")
    both = short.unionByName(align_long(docs.where(beyond), a_path, b_path, unit, width, fan))
    path = f"{shared_dir(docs.sparkSession)}/aligned-{uuid.uuid4().hex}"
    table = both.withColumn("row", F.monotonically_increasing_id())
    table.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(table.schema).parquet(path)


def read_groups(batch: pa.RecordBatch) -> Aligned:
    """Of rows of align()."""
    def flat(name: str, kinds: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = [np.frombuffer(x, k) for x, k in zip(batch.column(name).to_pylist(), kinds)]
        return np.concatenate([_NO_IDS, *own]).astype(np.uint32), np.cumsum([0, *map(len, own)])

    sizes = batch.column("size").to_pylist()
    ids = [f"<u{x // 8}" for x in sizes]
    (a, a_edge), (b, b_edge), (g, g_edge) = flat("a", ids), flat("b", ids), flat("groups", [f"<u{x % 8}" for x in sizes])
    return Aligned(a, b, g[::2], g[1::2], a_edge, b_edge, g_edge // 2)


def _count_pairs(held: int):
    """(pair, n): documents that hold it linked, of some of a task's documents."""

    def merged(found: list) -> tuple[np.ndarray, np.ndarray]:
        pairs, n = (np.concatenate(z) for z in zip(*found))
        order = np.argsort(pairs, kind="stable")
        pairs, n = pairs[order], n[order]
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
        return pairs[first], np.add.reduceat(n, first) if len(first) else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        found, size = [], 0
        out = lambda pairs, n: pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])
        for batch in parts(batches, size=1 << 20):
            doc, pair, _ = read_groups(batch).links()
            once = np.unique(doc.astype(np.int64) << _PAIR_BITS | pair) & ((1 << _PAIR_BITS) - 1)
            found.append(np.unique(once, return_counts=True))
            size += len(found[-1][0])
            if size > 2 * held:
                found = [merged(found)]
                size = len(found[0][0])
                if size > held:
                    yield out(*found[0])
                    found, size = [], 0
        if found:
            yield out(*merged(found))

    return run


def pair_counts(aligned: DataFrame, held: int = HELD_PAIRS) -> DataFrame:
    """(pair, n): the documents that hold a pair linked; written in the shared folder. Tasks add up before the shuffle."""
    partial = aligned.select("size", "a", "b", "groups").mapInArrow(_count_pairs(held), "pair long, n long")
    return staged(partial.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")


def _score(sent):
    number = sent._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = keep(("pairs", number), lambda: sent.value)
        for batch in parts(batches, size=1 << 20):
            doc, pair, times = read_groups(batch).links()
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            n = np.where(pairs[at] == pair, counts[at], 1) if len(pairs) else np.ones(len(pair), np.int64)
            top = n == best[pair >> _B_BITS]
            total = lambda x: np.bincount(doc, x, batch.num_rows).astype(np.int64)
            kept = ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            exact = np.zeros(batch.num_rows, np.int64)
            np.add.at(exact, doc, n * times)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(total(top * times)), pa.array(exact)], [*kept, "n_best", "count_sum"])

    return run


def _rare(sent):
    """(row, pair, times): of each document the distinct links that the broadcast table hasn't."""
    number = sent._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, _, _ = keep(("pairs", number), lambda: sent.value)
        for batch in parts(batches, size=1 << 20):
            doc, pair, times = read_groups(batch).links()
            rest = ~np.isin(pair, pairs)
            keys, of = np.unique(doc[rest].astype(np.int64) << _PAIR_BITS | pair[rest], return_inverse=True)
            row = batch.column("row").take(pa.array(keys >> _PAIR_BITS))
            yield pa.RecordBatch.from_arrays([row, pa.array(keys & ((1 << _PAIR_BITS) - 1)), pa.array(np.bincount(of, times[rest], len(keys)).astype(np.int64))], ["row", "pair", "times"])

    return run


def link_scores(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: n_best are the links whose pair is in as many documents as any of its A id's, count_sum adds up these documents over the links.

    A pair that one document holds needs no table. Of the others the most frequent travel to all
    tasks, broadcast_pairs at most; if some are left, documents meet those by a join, in which a pair
    has few documents.
    """
    spark = aligned.sparkSession
    often = counts.where("n > 1")
    scale = often.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count("*").alias("pairs")).orderBy(F.desc("p")).collect()  # 63 rows at most
    least, total = 1 << 62, 0
    for r in scale:
        total += r["pairs"]
        if total > broadcast_pairs:
            break
        least = 1 << r["p"]
    sent_rows = often.where(F.col("n") >= least).orderBy("pair").toArrow()  # broadcast_pairs rows at most
    tops = counts.groupBy(F.shiftright("pair", _B_BITS).cast("int").alias("a")).agg(F.max("n").alias("best"))
    top_rows = tops.toArrow()  # A's vocabulary at most
    best = np.zeros(1 << _B_BITS, np.int64)
    best[top_rows.column("a").to_numpy()] = top_rows.column("best").to_numpy()
    value = spark.sparkContext.broadcast((sent_rows.column("pair").to_numpy(), sent_rows.column("n").to_numpy(), best))
    kind = aligned.schema["doc_id"].dataType.simpleString()
    scored = aligned.mapInArrow(_score(value), f"doc_id {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    if total > broadcast_pairs:
        rest = aligned.select("row", "size", "a", "b", "groups").mapInArrow(_rare(value), "row long, pair long, times long").join(often.where(F.col("n") < least), "pair")
        known = rest.withColumn("a", F.shiftright("pair", _B_BITS).cast("int")).join(F.broadcast(tops), "a")  # A's vocabulary at most
        more = known.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * (F.col("n") - 1)).alias("_sum"))
        scored = scored.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))})
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
