"""The stored indexes: what lookups open, appends, replaced documents, merges and races."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tenderlake.functions.text import search_tokens
from tenderlake.operators.rows import matches_any
from tenderlake.plans import index, substring
from tenderlake.sources import commits, ranges


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def _keys(df):
    return sorted(r["key"] for r in df.collect())


def test_versions_are_published_once(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert commits.versions(spark, root) == [] and commits.content(spark, root) is None
    assert commits.publish(spark, root, 1, {"a": [1]}) and commits.publish(spark, root, 2, {"a": [2]})
    assert not commits.publish(spark, root, 2, {"a": [3]})
    assert commits.versions(spark, root) == [1, 2]
    assert commits.content(spark, root) == {"a": [2]} and commits.content(spark, root, 1) == {"a": [1]} and commits.content(spark, root, 7) is None


def test_lookups_open_their_files_only(spark, tmp_path):
    ranges.write_ranges(spark.range(1000).select(F.col("id").cast("string").alias("k"), "id"), str(tmp_path / "t"), "k", files=8)
    assert len(list((tmp_path / "t/data").glob("*.parquet"))) == 8
    found = ranges.read_values(spark, str(tmp_path / "t"), "k", ["17", "none"])
    assert [r["id"] for r in found.collect()] == [17] and len(found.inputFiles()) <= 2
    assert ranges.read_values(spark, str(tmp_path / "t"), "k", []).count() == 0


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('index')}/i"
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    first = [(i, " ".join(rnd.choices(words, k=8)) + (" Rare" if i % 90 == 0 else "") + " common") for i in range(400)]
    second = [(i, " ".join(rnd.choices(words, k=8)) + " common late") for i in range(400, 500)] + [(None, "common"), (500, None), (501, "")]
    third = [(i, "common changed") for i in range(0, 500, 7)] + [(7, "another row of seven")]
    states, state = [], {}
    for part in (first, second, third):
        index.append(_docs(spark, part), root)
        fresh = {k: [t for j, t in part if j == k] for k, _ in part if k is not None}
        state = {**state, **fresh}
        states.append(state)
    return root, states


def _brute(state, tokens):
    own = lambda t: set((t or "").lower().split())
    return sorted(k for k, texts in state.items() if any(set(tokens) <= own(t) for t in texts))


@pytest.mark.parametrize("words", [["common"], ["RARE", "common"], ["w1", "w2"], ["late"], ["changed"], ["w3", "common", "the"], ["seven", "another"], ["nowhere"], ["nowhere", "common"], ["the"], []])
def test_searches_by_version(spark, grown, words):
    root, states = grown
    for version, state in enumerate(states, 1):
        tokens = index.tokens_of(words)
        assert _keys(index.search(spark, root, words, version)) == (_brute(state, tokens) if tokens else [])


def test_an_append_leaves_earlier_runs_alone(spark, grown, tmp_path_factory):
    root, states = grown
    runs = [commits.content(spark, root, v)["runs"] for v in (1, 2, 3)]
    assert [len(r) for r in runs] == [1, 2, 3] and runs[2][:2] == runs[1]
    gone = spark.read.parquet(f"{root}/{runs[2][2]}/replaced")
    assert gone.count() == len([k for k in range(0, 500, 7)]) and {r["run"] for r in gone.select("run").distinct().collect()} == set(runs[1])


def test_merge_drops_what_was_replaced(spark, tmp_path):
    root = f"file://{tmp_path}/i"
    index.append(_docs(spark, [(1, "alpha beta"), (2, "beta")]), root)
    index.append(_docs(spark, [(1, "gamma beta"), (3, "beta")]), root)
    assert index.merge(spark, root) == 3 and index.merge(spark, root) == 3
    assert [_keys(index.search(spark, root, [w])) for w in ("alpha", "beta", "gamma")] == [[], [1, 2, 3], [1]]
    assert _keys(index.search(spark, root, ["alpha"], 1)) == [1]
    only = commits.content(spark, root)["runs"]
    assert {r["token"]: r["n"] for r in ranges.read_all(spark, f"{root}/{only[0]}/postings").collect()} == {"beta": 3, "gamma": 1}
    index.append(_docs(spark, [(2, "delta")]), root)
    assert {r["token"]: r["n"] for r in index.token_counts(spark, root).collect()} == {"beta": 2, "gamma": 1, "delta": 1}
    index.clean(spark, root)
    assert commits.versions(spark, root) == [4] and _keys(index.search(spark, root, ["beta"])) == [1, 3]
    assert len(list((tmp_path / "i").glob("run-*"))) == 2


def test_two_writers(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/i"
    index.append(_docs(spark, [(1, "a1")]), root)
    monkeypatch.setattr(index, "_last", lambda *_: 0)  # as seen before the other's append
    with pytest.raises(RuntimeError, match="another writer"):
        index.append(_docs(spark, [(2, "a1")]), root)
    monkeypatch.undo()
    assert _keys(index.search(spark, root, ["a1"])) == [1]


def test_frequent_tokens_lie_in_blocks(spark, tmp_path, monkeypatch):
    """No block is longer than BLOCK; next to a rare token only blocks near its rows are opened; rows are stored as differences."""
    monkeypatch.setattr(index, "BLOCK_BITS", 4)
    monkeypatch.setattr(index, "BLOCK", 16)
    root = f"file://{tmp_path}/i"
    docs = spark.range(600).coalesce(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("common "), F.when(F.col("id").isin(3, 5, 590), "rare").otherwise("")).alias("text"))
    index.append(docs, root)
    blocks = index.blocks_of(spark, root, ["common", "rare"])
    assert blocks.agg(F.max("n")).first()[0] <= 16 and blocks.where("token = 'common'").count() >= 600 // 16
    near = index.near_blocks(blocks, "rare")
    assert near.where("token = 'common'").count() == 2 and near.where("token = 'rare'").count() == 1
    assert _keys(index.search(spark, root, ["common", "rare"])) == [3, 5, 590]
    run = commits.content(spark, root)["runs"][0]
    encodings = set()
    for f in (tmp_path / "i" / run / "postings/data").glob("*.parquet"):
        group = pq.ParquetFile(f).metadata.row_group(0)
        encodings |= {e for k in range(group.num_columns) if group.column(k).path_in_schema.startswith("rows") for e in group.column(k).encodings}
    assert "DELTA_BINARY_PACKED" in encodings


def test_no_documents(spark, tmp_path):
    root = f"file://{tmp_path}/i"
    assert index.search(spark, root, ["a"]).count() == 0
    index.append(_docs(spark, [(None, "a"), (1, None)]), root)
    assert index.search(spark, root, ["a"]).count() == 0 and index.token_counts(spark, root).count() == 0
    with pytest.raises(ValueError, match="no version"):
        index.search(spark, root, ["a"], 9)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rnd = random.Random(3)
    names = ["Nord", "süd", "ÖST", "west%", "a_b", "😀smile", "", "ab", None]
    rows = [(i, f"{rnd.choice(names)} {rnd.choice(names)}{i}" if i % 5 else rnd.choice(names), None if i % 3 else f"Key#{i // 64:03d}") for i in range(640)]
    df = spark.createDataFrame(rows, "k long, name string, code string")
    root = str(tmp_path_factory.mktemp("substring"))
    substring.build(df, root, ["name", "code"], "k", block_bits=4, files=4)
    return df, root


@pytest.mark.parametrize("term", ["nord", "SÜD", "öst", "west%", "a_b", "😀sm", "key#003", "KEY#", "ab", "b", "", "nothing", "t% a_b1", "😀"])
def test_substrings_as_the_scan(spark, stored, term):
    df, root = stored
    want = sorted(map(tuple, df.where(matches_any(term, ["name", "code"])).collect()))
    for listed in (10_000, 0):
        assert sorted(map(tuple, substring.search(spark, root, term, ["name", "code"], listed).select("k", "name", "code").collect())) == want


def test_a_term_reads_its_blocks(spark, stored):
    """A term that stands in a tenth of the rows, one after the other, opens the blocks of these and one file."""
    df, root = stored
    blocks = spark.read.parquet(f"{root}/blocks").count()
    near = substring.blocks_for(spark, root, "Key#003").count()
    assert blocks >= 40 and 4 <= near <= 6
    found = substring.search(spark, root, "Key#003", ["name", "code"])
    assert len(found.inputFiles()) < 4 and found.count() == 22  # every third of 64 rows
    assert substring.blocks_for(spark, root, "key#zzz").count() == 0
    assert substring.blocks_for(spark, root, "ke").count() == blocks


def test_trigrams(spark):
    got = spark.createDataFrame([("ABCab",), ("ab",), ("",), (None,), ("a😀bc",)], "t string").select(substring.trigrams(F.col("t")).alias("g"), search_tokens(F.col("t"))).collect()
    assert [r["g"] for r in got] == [["abc", "bca", "cab"], [], [], [], ["a😀b", "😀bc"]]


def test_tokens_are_cut_by_a_table_of_characters(spark):
    """The class of what parts tokens names characters one by one: a union of ranges costs ten times as much."""
    got = spark.createDataFrame([("Ab_1-Zz9,é9 {x}~the\x00q",)], "t string").select(search_tokens(F.col("t")).alias("w"))
    assert got.first()["w"] == ["ab_1", "zz9", "9", "x", "q"]
    assert "a-z" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_postings_are_moved_straight_to_their_blocks(spark, tmp_path, monkeypatch):
    """No posting is written between its text and its block; of a merge with replaced documents no block is too long either."""
    monkeypatch.setattr(index, "BLOCK_BITS", 4)
    monkeypatch.setattr(index, "BLOCK", 16)
    named, own = [], index.scratch_dir
    monkeypatch.setattr(index, "scratch_dir", lambda s, name: named.append(name) or own(s, name))
    root = f"file://{tmp_path}/i"
    index.append(_docs(spark, [(i, "common") for i in range(40)]), root)
    index.append(_docs(spark, [(i, "changed") for i in range(30)]), root)
    assert index.merge(spark, root) == 3
    assert named == ["index-tokens", "index-frequent"] * 2 + ["index-rows", "index-frequent"]
    assert index.blocks_of(spark, root, ["common", "changed"]).agg(F.max("n")).first()[0] <= 16
    assert _keys(index.search(spark, root, ["common"])) == list(range(30, 40)) and {r["token"]: r["n"] for r in index.token_counts(spark, root).collect()} == {"common": 10, "changed": 30}
