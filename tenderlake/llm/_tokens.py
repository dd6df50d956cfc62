"""Encoding of whole texts with a public tokenizer file, one small piece at a time.

Byte-pair merges never cross the borders that a tokenizer's splitting pattern sets, so a text's ids
are those of its pieces, one after the other. A single blank between two words is always such a
border, and so is a change between letters, digits and other characters within one. numpy cuts some
documents at a time there, the distinct pieces, each with the blank before it, are encoded once, and
numpy puts the documents together. Words with bytes that need more care (apostrophes, most of what
isn't ASCII) are one piece, which the splitting pattern cuts. Each Python worker keeps the ids of the
pieces that it met last, KEPT_BYTES of them. Texts with other blanks are split as a whole.
Through the tokenizers library go, as a whole: texts with characters beyond SAFE, whose classes or
case might differ between Unicode versions; texts in which an added token of the file stands, such as
<|endoftext|>, which the library reads as that token (in any case, lest a tokenizer lower-cases
first); and tokenizers of another build. All ways give the ids of
Tokenizer.from_file(path).encode(text, add_special_tokens=False).
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa

from ._text import BLANK, Words, words_of
from ._worker import keep

KEPT_BYTES = 96 << 20
#: What a dict entry with a key and a value of no length takes, about.
_ENTRY = 180
SLICES = 8

# The splitting patterns of the two public tokenizers over SAFE characters.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼½¾"
SAFE = re.compile("[\t\n -~¡-¬®-įı-ſ]*")
BYTE_PIECE = re.compile(f" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBER}]+| ?[^ \t\n{_LETTER}{_NUMBER}]+|[ \t\n]+(?![^ \t\n])|[ \t\n]+")
WORD_PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_NUMBER}]|[^ \t\n{_LETTER}{_NUMBER}]+")


#: What a byte is in a word: nothing (a blank), a letter, a digit, another character; or the word is one piece.
_BLANK, _LETTERS, _DIGIT, _OTHER, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[list(BLANK)] = _BLANK
_CLASS[0x21:0x7F] = _OTHER
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = _LETTERS
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x27] = _ODD


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte: itself, or the next free one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class _Kept(dict):
    """key -> made(key), kept for the keys used last, about `room` bytes of them: once a half is full, what isn't asked for again goes with the half before."""

    def __init__(self, made: Callable, room: int):
        self.made, self.half, self.left, self.before = made, room // 2, room // 2, {}

    def __missing__(self, key):
        value = self.before[key] if key in self.before else self.made(key)
        self.left -= _ENTRY + len(key) + len(value or b"")
        if self.left < 0:
            self.before, self.left = dict(self), self.half
            self.clear()
        self[key] = value
        return value


class Encoder:
    """text -> ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.vocabulary = self.whole.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.model, self.letters = self.whole.model, _byte_letters()
        self.blanks = {c: self.letters[ord(c)] for c in " \n\t"}
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.kinds = _CLASS.copy()  # a word in which an added token may begin is one piece
        self.kinds[[b for x in added for b in (x[:1].lower() + x[:1].upper()).encode()]] = _ODD
        made = [json.loads(x.__getstate__()) if x is not None else None for x in (self.whole.normalizer, self.whole.pre_tokenizer)]
        before = json.dumps(made)
        self.pattern, self.lower = None, False
        if type(self.model).__name__ == "BPE" and not self.model.ignore_merges and not any(re.search(r"\s", x) for x in added):
            if made[0] is None and '"use_regex": true' in before and '"add_prefix_space": false' in before and "Split" not in before:
                self.pattern = BYTE_PIECE
            elif "[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in before and '"Lowercase"' in before and '"use_regex": false' in before:
                self.pattern, self.lower = WORD_PIECE, True
        self.words = _Kept(self._word, KEPT_BYTES)

    def _safe(self, text: str) -> bool:
        return SAFE.fullmatch(text) is not None and (self.added is None or self.added.search(text) is None)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join([self.letters[b] for b in piece.encode()])
        elif piece[:1] in self.blanks:
            piece = "".join([self.blanks.get(c, c) for c in piece])
        return array(self.kind, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _split(self, text: str) -> bytes:
        pieces = self.pattern.findall(text)
        if len(pieces) == 1:
            return self._piece(pieces[0])
        return b"".join([self.words[p.encode()] if p != text else self._piece(p) for p in pieces])

    def _word(self, word: bytes) -> bytes | None:
        """Of a word, with the blank before it if blanks count; None if it isn't safe."""
        text = word.decode("utf-8", "replace")
        if not self._safe(text):
            return None
        if self.lower:
            text = text.lower()
        if word[word[:1] == b" " :].isalpha():  # ASCII letters after a space, if any: one piece
            return self._piece(text)
        return self._split(text)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        if self.pattern is None or not self._safe(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype)
        return np.frombuffer(self._split(text.lower() if self.lower else text), self.dtype)

    def encode_column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string column."""
        if self.pattern is None:
            yield from map(self.encode, column.to_pylist())
            return
        slices = words_of(column, lower=self.lower)
        while group := [*islice(slices, SLICES)]:
            yield from self._encode_slices(column, group)

    def _cut(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each piece, the first piece of each document (and their number at the end), and which documents have single blanks only."""
        leads = np.zeros(len(w.start), bool)  # words that begin their document's words
        leads[w.edge[:-1][w.counts > 0]] = True
        blank = np.zeros(len(w.start), np.uint8)  # the byte before a word
        blank[~leads] = w.buf[w.start[~leads] - 1]
        kind = self.kinds[w.buf]
        after = np.flatnonzero(w.buf == 0xC3) + 1  # two bytes of a letter, but for the signs of multiplication and division
        after = after[after < len(w.buf)]
        kind[after] = np.where((w.buf[after] == 0x97) | (w.buf[after] == 0xB7), _ODD, _LETTERS)
        upper = after[(w.buf[after] < 0xA0) & (kind[after] == _LETTERS)] if self.lower else after[:0]
        kind[upper] = _ODD
        odd = np.maximum.reduceat(kind, w.start) == _ODD if len(w.start) else leads
        if not self.lower:
            odd |= ~leads & (blank != 0x20)
        inside = np.zeros(len(w.buf) + 1, np.int8)
        inside[w.start[odd]] += 1
        inside[w.end[odd]] -= 1
        begin = np.zeros(len(w.buf), bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT if self.lower else False)
        begin &= (kind != _BLANK) & (np.cumsum(inside[:-1]) == 0)
        begin[w.start] = True
        start = np.flatnonzero(begin)
        word = np.searchsorted(w.start, start, "right") - 1
        end = np.minimum(np.append(start[1:], len(w.buf)), w.end[word])
        edge = np.searchsorted(start, np.append(w.start, len(w.buf)))[w.edge]
        if self.lower:
            return start, end, edge, np.ones(len(w.counts), bool)
        start = start - ((start == w.start[word]) & ~leads[word])
        gap = np.ones(len(w.start), np.int64)
        gap[1:] = w.start[1:] - w.end[:-1]
        apart = np.where(leads, w.start != np.repeat(w.at[:-1], w.counts), (gap != 1) | (blank != 0x20) & (blank != 0x0A))
        bad = np.add.reduceat(np.append(apart, False), np.minimum(w.edge[:-1], len(apart))) > 0 if len(w.counts) else np.zeros(0, bool)
        last = np.where(w.counts > 0, w.end[np.maximum(w.edge[1:] - 1, 0)] if len(w.end) else 0, w.at[:-1])
        return start, end, edge, ~((w.counts > 0) & bad) & (last == w.at[1:])

    def _encode_slices(self, column: pa.Array, group: list[Words]) -> Iterator[np.ndarray]:
        cuts = [self._cut(w) for w in group]
        _, first, inverse = np.unique(np.concatenate([w.hashes(start, end) for w, (start, end, _, _) in zip(group, cuts)]), return_index=True, return_inverse=True)
        base = np.cumsum([0, *(len(start) for start, _, _, _ in cuts)])
        of = np.searchsorted(base, first, "right") - 1
        turn = np.argsort(of, kind="stable")
        found: list[bytes | None] = []
        for s, (w, (start, end, _, _)) in enumerate(zip(group, cuts)):
            i = first[turn[np.searchsorted(of[turn], s) : np.searchsorted(of[turn], s, "right")]] - base[s]
            raw = w.buf.tobytes()
            found += map(self.words.__getitem__, [raw[x:y] for x, y in zip(start[i].tolist(), end[i].tolist())])
        safe = np.ones(len(first), bool)
        safe[turn] = [x is not None for x in found]
        size = self.dtype.itemsize
        flat = np.frombuffer(b"".join([x or b"" for x in found]), self.dtype)
        length, begin = np.zeros((2, len(first)), np.int64)
        length[turn] = [len(x or b"") // size for x in found]
        begin[turn] = np.cumsum(length[turn]) - length[turn]
        for w, low, (start, _, edge, ok) in zip(group, base.tolist(), cuts):
            own = inverse[low : low + len(start)]
            n = length[own]
            to = np.cumsum(n)
            ids = flat[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(begin[own] - (to - n), n)]
            ends = np.concatenate([[0], to])[edge]
            unsafe = np.concatenate([[0], np.cumsum(~safe[own])])[edge]
            ok &= unsafe[1:] == unsafe[:-1]
            for d in range(len(w.counts)):
                yield ids[ends[d] : ends[d + 1]] if ok[d] else self.encode(column[w.first + d].as_py())


def encoder(path: str) -> Encoder:
    """This worker's encoder of a tokenizer file."""
    return keep(("encoder", path), lambda: Encoder(path))
