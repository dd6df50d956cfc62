"""Operators whose results brute force, or SQL, can give."""

import brute
import pytest
from oracle import same
from pyspark.sql import functions as F

from tenderlake.llm import decontaminate as dc
from tenderlake.llm import jaccard_join, line_dedup, quality, queries, substring_dedup


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    same(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), queries.ORACLE_SQL[name], "/root/testdata/sf0.001")


@pytest.mark.parametrize("room", [1 << 26, 1])
def test_line_dedup(docs, rows, none, monkeypatch, room):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    plain = docs.select("doc_id", "text")
    found = line_dedup.dedup_lines(plain, min_docs=3, broadcast_bytes=room).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got(found) == sorted(brute.line_dedup(rows, 3), key=repr)
    assert line_dedup.dedup_lines(none.select("doc_id", "text")).count() == 0


def test_perfect_hash():
    import numpy as np

    rng = np.random.default_rng(0)
    hi, lo = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    shard = line_dedup.build_shard(hi, lo, np.arange(1, 5001))
    assert (line_dedup.probe(shard, hi, lo) == np.arange(1, 5001)).all()
    assert not line_dedup.probe(shard, lo, hi).any()


@pytest.mark.parametrize("hot", [10_000, 12, 1])
def test_substring_dedup(docs, rows, none, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    plain = docs.select("doc_id", "text")
    found = substring_dedup.dedup_substrings(plain, 35).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert got(found) == sorted(brute.substrings(rows, 35), key=repr)
    assert substring_dedup.dedup_substrings(none.select("doc_id", "text")).count() == 0


@pytest.mark.parametrize(("small", "block", "often"), [(64, 1500, 1000), (2, 1500, 1), (2, 3, 6)])
def test_jaccard_components(docs, rows, none, monkeypatch, small, block, often):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "OFTEN", often)
    assert got(jaccard_join.jaccard_components(docs, 4, 85)) == sorted(brute.components(rows, 4, 85), key=repr)
    assert jaccard_join.jaccard_components(none).count() == 0


def test_keep_one(docs, rows):
    kept = [r["doc_id"] for r in jaccard_join.keep_one(docs, 5, 80).collect()]
    assert sorted(kept) == sorted({c for _, _, c, _ in brute.components(rows, 5, 80)})
    twice = docs.union(docs)
    assert sorted(r["doc_id"] for r in jaccard_join.keep_one(twice, 5, 80).collect()) == sorted(kept)


def test_shingles_alone_stay(spark):
    """Of prefixes, only the shingles that two nodes share are dealt out, once for a node that several tasks met."""
    import numpy as np

    own = np.random.default_rng(0).integers(0, 1 << 62, (2000, 20))
    own[1::2, :2] = own[::2, :2]
    rows = [(k, k % 2000, 20, int(own[k % 2000, -1]), own[k % 2000].tolist()) for k in range(4000)]
    sets = spark.createDataFrame(rows, "row long, sig long, n_shingles long, last long, prefix array<long>").withColumn("row", F.xxhash64("row"))
    nodes = sets.groupBy("sig").agg(F.min("row").alias("row"), F.count("last").alias("prefixes"), F.lit(20).alias("tokens"))
    first = spark.sparkContext.broadcast(jaccard_join._bloom.build(nodes.select("row"), 2000))
    marks = spark.sparkContext.broadcast(jaccard_join.recurring(sets, first, 40_000))
    dealt = [tuple(r) for r in sets.mapInArrow(jaccard_join._dealt(first, marks), "token long, sig long, n long, last long").collect()]
    assert {(int(t), k) for k in range(2000) for t in own[k, :2]} <= {(t, sig) for t, sig, _, _ in dealt}
    assert all((n, last) == (20, own[sig, -1]) for _, sig, n, last in dealt)
    assert len(dealt) < 6000  # 4,000 and what meets by chance; all prefixes are 80,000


def test_jaccard_in_ranges(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "RANGE", 4)
    monkeypatch.setattr(jaccard_join, "MAP_BITS", 16)
    monkeypatch.setattr(jaccard_join, "SENT", 0)
    assert got(jaccard_join.jaccard_components(docs, 4, 85)) == sorted(brute.components(rows, 4, 85), key=repr)


def test_keep_one_moves_names(docs, rows, monkeypatch):
    """Rows are told by names that are broadcast: whole rows meet no sort, unless there are too many names."""
    kept = jaccard_join.keep_one(docs, 5, 80)
    assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(jaccard_join, "SENT", 0)
    assert got(jaccard_join.keep_one(docs.union(docs), 5, 80)) == got(kept)


@pytest.mark.parametrize("room", [200_000, 60])
def test_decontamination(spark, docs, rows, none, room):
    texts = [t for _, t in rows if t]
    items = [(1, " ".join(texts[20].split()[2:30])), (2, texts[30].upper()), (3, "a b c d"), (4, None), (5, "!!"), (6, "w w w"), (10, "A.b,C;d:e"), (7, texts[20]), (7, texts[20])]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = dc.find_overlaps(docs.select("doc_id", "text"), table, 10, shard_words=room)
    told = found.select("doc_id", "n_words", dc.hit_words().alias("h"), F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256), F.size("spans") > 0)
    assert got(told) == sorted(brute.overlaps(rows, items, 10), key=repr)
    assert dc.report(none, table).count() == 0
    assert not dc.report(docs, table.limit(0)).where("contaminated").count()


def test_cut_passages(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"Keep this, {passage.upper()}! " + "and that too " * 8), (2, passage), (3, "clean"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a", passage)], "item_id string, text string")
    out = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs, items).collect()}
    assert out == {1: "Keep this, ! " + "and that too " * 8, 3: "clean", 4: None}


def test_quality(docs, rows, none):
    ledger = quality.ledger(docs)
    measured = {r["doc_id"]: r for r in ledger.collect()}
    for d, t in rows:
        r = measured[d]
        w = brute.words(t)
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), brute.repeat_words(t)), d
        assert bool(r["fail_bits"] & 1) == (len(w) < 50)
    kept = quality.apply_policy(ledger, quality.DEFAULT).where("kept").count()
    table = {r["rule"]: r for r in quality.ablations(ledger, quality.DEFAULT).collect()}
    for name in quality.RULES:
        rest = quality.Policy("x", tuple(r for r in quality.RULES if r != name))
        assert table[name]["kept_without"] == quality.apply_policy(ledger, rest).where("kept").count()
        assert table[name]["kept_without"] - table[name]["failed_alone"] == kept
    assert quality.ledger(none).count() == 0
