"""Token files and packing: the library's ids, and exact round trips."""

import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenderlake.llm import _tokens, packing, token_file

HARD = ["a  b\n\n c\t d", "I'm he'LL 'S ſt don't  '' ' s", "  x", "x  ", "x\n", "\nx", "x\n\ny", "a b\nc d", "İ Iı ǅ", "12345 ²³ a1b2 ", "<|endoftext|> <|startoftext|>", "hello <|endoftext|> world", "A <|EndOfText|>x<|startoftext|> B", "Ärger ÉCOLE œuvre Ÿ ×÷ a×b ñ1ñ2 Äb12cd34, e.g. x_y-z3#", "a  É", "it's, we're; o'neil's 1st 22nd", "glued<|endoftext|>words \n <|endoftext|>", "<|endoftext", "😀 ok", "\x1c\x85\xa0 z", "é", "a\r\nb", "'re're 've"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_same_ids_as_the_library(name, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(_tokens, "KEPT_BYTES", 10_000)
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    texts = [t for _, t in brute.corpus()] + HARD
    code = _tokens.Encoder(path)
    assert code.pattern is not None
    for text, ids in zip(texts, code.encode_column(pa.array(texts)), strict=True):
        assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 32])
def test_bits(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000, dtype=np.uint64).astype(np.uint32)
    raw = token_file.pack(ids, width)
    assert len(raw) == -(-1000 * width // 8)
    for a, b in ((0, 1000), (0, 0), (7, 8), (13, 777), (999, 1000)):
        assert (token_file.unpack(raw, width, a, b) == ids[a:b]).all()


def library_ids(name, rows, end):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    return {d: [*whole.encode(t or "", add_special_tokens=False).ids, end] for d, t in rows}


def test_token_file(spark, docs, rows, none, tmp_path, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK_IDS", 64)
    token_file.write_token_file(docs, str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"), 2)
    read = sorted(token_file.read_token_file(spark, str(tmp_path / "t")).collect(), key=lambda r: r["doc_id"])
    ids, start = library_ids("word_bpe_49k.json", rows, 2), 0
    for (d, _), r in zip(sorted(rows), read, strict=True):
        own = np.array(ids[d], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    block = token_file.read_blocks(spark, str(tmp_path / "t")).orderBy("shard", "block").collect()
    shard = block[0]["shard"]
    every = np.concatenate([token_file.unpack(b["payload"], b["width"], 0, b["ends"][-1]) for b in block if b["shard"] == shard])
    assert (token_file.read_ids(spark, str(tmp_path / "t"), shard, 3, len(every) - 2) == every[3:-2]).all()
    token_file.write_token_file(none, str(tmp_path / "e"), public_tokenizers.path("word_bpe_49k.json"), 2)
    assert token_file.read_token_file(spark, str(tmp_path / "e")).count() == 0


def test_packing(docs, rows, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack_documents(docs.union(docs.where("doc_id = 20")), path, 0, 1024)
    ids = library_ids("byte_bpe_50k.json", rows, 0)
    by_doc, by_seq = {}, {}
    for r in pieces.collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for d, own in ids.items():
        found = sorted(by_doc[d], key=lambda r: (r["sequence_id"], r["offset"]))
        whole = b"".join(bytes(r["ids"]) for r in found)
        assert whole == np.array(own * (2 if d == 20 else 1), "<u4").tobytes()
        assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and r["doc_tokens"] == len(own) for r in found)
    for k in range(len(by_seq)):
        at = 0
        for r in sorted(by_seq[k], key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == 1024 or k == len(by_seq) - 1
    assert packing.sequences(pieces).count() == len(by_seq)
    assert packing.pack_documents(none, path, 0).count() == 0


@pytest.mark.parametrize("kind", ["string", "long"])
def test_names_keep_their_type(spark, tmp_path, kind):
    rows = [("7", "a b"), (None, "c"), ("7", None), ("10", "<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(2)
    token_file.write_token_file(docs, str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"), 2)
    for df in (token_file.read_token_file(spark, str(tmp_path / "t")), packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)):
        assert dict(df.dtypes)["doc_id"] == docs.schema["doc_id"].dataType.simpleString()
        assert sorted(map(str, (r["doc_id"] for r in df.collect()))) == ["10", "7", "7", "None"]


def test_sequences_are_padded(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, 5)
    found = {r["sequence_id"]: (r["n"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()) for r in packing.sequences(pieces, 5, 9).collect()}
    assert [len(x) for _, x in found.values()] == [5, 5] and found[1][0] == 3 and found[1][1][2:] == [0, 9, 9]
