"""Alignment of two tokenizers against a plain form over the libraries' own tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tenderlake.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "   ", "a", "\n", "a ", " a", "a  b", "a\n\nb c\t d", "don't stop <|endoftext|> <s> </s> <unk> <0x0A> x", "naïve café ﬁ ² ½ Ａ １２", "日本語のテキストです。 中文 한국어 text", "🙂🙂 👩‍👩‍👧 ok", "sep▁arator", "1234567890 3.14159 0x1F", "x" * 700, "http://a.b/c?d=e&f=%20 (see [1], {2})...", "a b　c​d", "\x00 nul \x7f del", "tab\ttab\r\nline", "A" * 30 + " " + "é" * 40, "word " * 300, "one.\nTwo three,\nfour 'five\n'six\n\nseven\n eight \nnine\n", "\nfirst\nx", "a\nb\nc\n1\n2"]


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    letters = {c: b for b, c in enumerate(al.Encoder(A).letters)}
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    a_bytes = lambda i: bytes(letters[c] for c in t.id_to_token(i))
    b_bytes = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    return lambda x: ([(i, a_bytes(i)) for i in t.encode(" " + x, add_special_tokens=False).ids], [(i, b_bytes(i)) for i in sp.encode(x)])


def groups_of(tools, text):
    if not text:
        return []
    a, b = tools(text)
    raw = (" " + text).encode()
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return []
    ends = [dict(zip(np.cumsum([len(x) for _, x in t]).tolist(), range(1, len(t) + 1))) for t in (a, b)]
    cuts = sorted(ends[0].keys() & ends[1].keys())
    out, i, j = [], 0, 0
    for c in cuts:
        out.append(([x for x, _ in a[i : ends[0][c]]], [x for x, _ in b[j : ends[1][c]]]))
        i, j = ends[0][c], ends[1][c]
    return out


def brute(tools, rows):
    each = [(d, groups_of(tools, t)) for d, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in each]
    n = Counter(p for own in links for p in own)
    best = {}
    for (x, _), k in n.items():
        best[x] = max(best.get(x, 0), k)
    for (d, g), own in zip(each, links):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        yield d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), sum(k for p, k in own.items() if n[p] == best[p[0]]), sum(k * n[p] for p, k in own.items()), hashlib.sha256(said.encode()).hexdigest() if g else ""


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    parts = [t for t in TEXTS if t]
    mixed = [rnd.choice(["", " ", "\n", "  "]).join(rnd.choice(parts) for _ in range(rnd.randrange(1, 9))) for _ in range(40)]
    texts = TEXTS + mixed + mixed[:5]
    return [*enumerate(texts), (None, "no id"), (None, "no id"), (3, "an id again")]


@pytest.fixture(scope="module")
def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("mine") for c in ("row", "seq", "part", "a", "n_a", "size", "pair", "n")}).repartition(4)


def test_short_and_long_texts(tools, rows, frame):
    """In their row, and as fragments of a few bytes that a tree puts together; counts broadcast, and met by a join."""
    want = sorted(brute(tools, rows), key=repr)
    assert sum(x[3] > 0 for x in want) > 50
    for how, most in [({}, 1 << 20), ({"long": 2, "unit": 40, "width": 7, "fan": 2}, 30), ({"long": 60, "unit": 16, "width": 64, "fan": 3}, 0)]:
        aligned = al.align(frame, A, B, **how)
        out = al.link_scores(aligned, al.pair_counts(aligned, held=50), broadcast_pairs=most)
        assert sorted(map(tuple, out.collect()), key=repr) == want


def test_no_rows(frame):
    aligned = al.align(frame.limit(0), A, B)
    assert al.link_scores(aligned, al.pair_counts(aligned)).count() == 0


def test_fragments_compose_in_any_order():
    """Cut anywhere and put together in any nesting, fragments give the groups of the whole."""
    rnd = random.Random(9)
    for _ in range(200):
        n = rnd.randrange(1, 40)
        ends = [np.array(sorted({*rnd.sample(range(1, n + 1), rnd.randrange(1, n + 1)), n})) for _ in range(2)]
        ids = [np.arange(len(e), dtype=np.uint32) + 1000 * k for k, e in enumerate(ends)]
        want = al.whole(al.fragment(ids[0], ends[0], ids[1], ends[1]))
        edges = sorted({0, n, *(rnd.randrange(n + 1) for _ in range(rnd.randrange(8)))})
        part = lambda k, lo, hi: slice(*np.searchsorted(ends[k], [lo, hi], "right"))
        found = [al.fragment(ids[0][part(0, lo, hi)], ends[0][part(0, lo, hi)], ids[1][part(1, lo, hi)], ends[1][part(1, lo, hi)]) for lo, hi in zip(edges, edges[1:])]
        while len(found) > 1:
            k = rnd.randrange(len(found) - 1)
            found[k : k + 2] = [al.compose(*found[k : k + 2])]
        for x, y in zip(al.whole(found[0]), want):
            assert x.tolist() == y.tolist()


def test_group_of_many_links():
    """Equal links of a large group are put together, and add up to all of them."""
    a, b = np.array([5, 6, 5, 6, 5] * 30, np.uint32), np.array([7, 8, 8] * 10, np.uint32)
    x = al.Aligned(a, b, np.array([150], np.uint32), np.array([30], np.uint32), *(np.array([0, k]) for k in (150, 30, 1)))
    doc, pair, times = x.links()
    assert len(pair) == 4 and times.sum() == 150 * 30 and not doc.any()
    assert dict(zip(pair.tolist(), times.tolist())) == {5 << 20 | 7: 900, 5 << 20 | 8: 1800, 6 << 20 | 7: 600, 6 << 20 | 8: 1200}
