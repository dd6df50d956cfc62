"""Null keys, extra columns and clashing names."""

import pytest
from oracle import same
from pyspark.sql import functions as F

from tenderlake.llm import decontaminate, jaccard_join, langid, line_dedup, packing, quality, queries, secrets, substring_dedup, token_file, toxicity

TEXTS = ["one two three four five six", None, "", "one two three four five six", " ".join(f"w{i}" for i in range(80))]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows without a doc_id, rows that repeat, and columns named as results or helpers are."""
    names = ["n_words", "n_lines", "n_dropped", "n_removed", "kept_text", "kept_sha256", "spans", "items", "lang_pred", "score", "row", "_text", "_c0", "sig", "did", "key", "_key", "label", "word", "finding", "n_shingles", "component_id", "fail_bits", "part", "at", "n", "_copy", "_least", "_least_hash", "text_hash", "row_hash"]
    rows = [(d, t) for d in (None, 1, 1) for t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("mine").alias(n) for n in names])


def test_all_rows_stay(spark, odd, tmp_path):
    import public_tokenizers

    byte, word = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
    n = odd.count()
    items = spark.createDataFrame([("i", TEXTS[4])], "item_id string, text string")
    model = langid.train(odd.withColumn("lang", F.lit("en")))
    tox = toxicity.train(odd, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    token_file.write_token_file(odd, str(tmp_path / "t"), word, 2)
    for df in (
        line_dedup.dedup_lines(odd, 3),
        substring_dedup.dedup_substrings(odd),
        decontaminate.report(odd, items),
        jaccard_join.jaccard_components(odd),
        langid.identify(odd, model),
        toxicity.toxicity(odd, tox),
        quality.apply_policy(quality.ledger(odd), quality.DEFAULT),
        token_file.read_token_file(spark, str(tmp_path / "t")),
        packing.pack_documents(odd, byte, 0, 1 << 20),
    ):
        assert df.count() == n
        assert len(set(df.columns)) == len(df.columns)
    assert secrets.scan(odd).count() == 0


def test_results_take_the_names(odd):
    assert line_dedup.dedup_lines(odd, 3).where("n_lines = 1").count() == odd.count()
    assert substring_dedup.dedup_substrings(odd).where("n_words = 80 and n_removed = 80").count() == 3
    assert decontaminate.find_overlaps(odd, odd.sparkSession.createDataFrame([("i", "w1 w2")], "item_id string, text string")).where("size(spans) = 1").count() == 3


def test_cut_keeps_columns(spark, odd):
    items = spark.createDataFrame([("i", "two three four")], "item_id string, text string")
    out = decontaminate.decontaminate(odd, items, max_coverage=0.6)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.where("text = 'one  five six' and spans = 'mine'").count() == 6
    assert jaccard_join.keep_one(odd).columns == odd.columns


def test_keep_one_by_text(spark):
    """Ids that are null or used again don't cost a text that no other row has."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (1, c), (5, c + " more"), (5, d), (None, d), (None, ""), (None, ""), (None, None), (7, ""), (7, None), (7, None)]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [(None, a), (None, b), (1, c), (5, d), (None, ""), (None, ""), (None, None), (7, ""), (7, None)]))


def test_items_without_a_name(spark, tmp_path):
    """Their windows hit as the SQL's do, in one automaton and in several."""
    long, short, mine = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("l", 14), ("s", 3), ("m", 12)))
    docs = spark.createDataFrame([(1, f"x {long} y"), (2, f"{short} z"), (3, f"{mine} {long}"), (4, "clean"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, long), (None, short), (None, None), ("a", mine), ("b", f"{short} {mine}")], "item_id string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    found = queries.op1_decontaminate(spark, str(tmp_path))
    same(found, queries.OP1_SQL, str(tmp_path))
    assert {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in found.collect()} == {1: (14, 0), 2: (3, 0), 3: (26, 2), 4: (0, 0), 5: (0, 0)}
    apart = decontaminate.find_overlaps(docs, items, 10, shard_words=20)
    assert {r["doc_id"]: (r["n"], r["items"]) for r in apart.select("doc_id", decontaminate.hit_words().alias("n"), "items").collect()} == {1: (14, []), 2: (3, []), 3: (26, ["a", "b"]), 4: (0, []), 5: (0, [])}
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()} == {4, 5}


def test_many_copies_of_a_row(spark):
    """Thousands of equal rows cost op10 no more than their number."""
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(10_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(8)
    assert substring_dedup.dedup_substrings(docs).where("n_words = 60 and n_removed = 60 and kept_text = ''").count() == 10_000


def test_keep_one_of_rows_that_tie(spark):
    """Of rows with one doc_id and text, the same one stays however they are dealt."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, f"source {k}", k) for k in range(20)] + [(2, "", "a", 1), (2, "", "a", 1), (2, "", "b", 1)]
    kept = [sorted(map(tuple, jaccard_join.keep_one(spark.createDataFrame(r, "doc_id long, text string, source string, _copy long").repartition(n)).collect())) for r, n in ((rows, 5), (rows[::-1], 2))]
    assert kept[0] == kept[1] and [r[0] for r in kept[0]] == [1, 2, 2]
