"""A stored inverted index over documents, in runs.

An append writes a run: its documents with row numbers, and postings in blocks sorted by token, of
BLOCK rows at most, with the first and last row of each; Parquet stores the rows as differences. A
token of many documents has a block for each BLOCK row numbers, so no list of all its documents is
ever gathered, and a search for it with a rarer one opens the blocks near the rarer one's only. Runs
before are left as they are: documents that the new run has again are listed as replaced. `merge` puts
runs together and drops what was replaced. A version (sources.commits) names the runs that count, so
searches see an append whole or not at all, and versions before it stay readable until `clean`.

Rows without a key can't be found and are left out. Rows that share a key in one append are documents
of their own, and a search returns the key once. A null text has no token.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, search_tokens
from ..session import scratch_dir
from ..sources import commits
from ..sources.ranges import read_all, read_values, write_ranges

BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
#: Rows as differences; a dictionary of them would be as long as they are.
DELTA = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#rows.list.element": "false"}


def _block(row: Column) -> Column:
    return F.shiftright(row, BLOCK_BITS)


def _write_postings(postings: DataFrame, totals: DataFrame, path: str) -> None:
    """postings (token, row), each once, as blocks (token, low, high, n, rows). totals (token, total): how many rows a token has, or more. Postings are moved once, straight to their blocks."""
    spark = postings.sparkSession
    stage = scratch_dir(spark, "index-frequent")
    # one token for each BLOCK postings at most; written, so that Spark knows its size
    totals.where(F.col("total") > BLOCK).select("token", F.lit(True).alias("frequent")).write.parquet(stage)
    frequent = spark.read.schema("token string, frequent boolean").parquet(stage)
    # tokens of few documents have one block in all
    block = F.when(F.col("frequent"), _block(F.col("row"))).otherwise(F.lit(-1))
    blocks = postings.join(frequent, "token", "left").groupBy("token", block.alias("block")).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    shaped = blocks.select("token", F.get("rows", F.lit(0)).alias("low"), F.element_at("rows", -1).alias("high"), F.size("rows").alias("n"), "rows")
    write_ranges(shaped, path, "token", "low", **DELTA)


def _runs(spark: SparkSession, root: str, version: int | None) -> list[str]:
    said = commits.content(spark, root, version)
    if said is None and version is not None:
        raise ValueError(f"there is no version {version}")
    return said["runs"] if said else []


def _publish(spark: SparkSession, root: str, base: int, runs: list[str]) -> int:
    if not commits.publish(spark, root, base + 1, {"runs": runs}):
        raise RuntimeError("another writer changed the index meanwhile; do this again")
    return base + 1


def _last(spark: SparkSession, root: str) -> int:
    return (commits.versions(spark, root) or [0])[-1]


def _documents(spark: SparkSession, root: str, runs: list[str]) -> DataFrame | None:
    """(run, row, key) of runs, replaced ones among them."""
    each = [read_all(spark, f"{root}/{r}/documents").withColumn("run", F.lit(r)) for r in runs]
    return reduce(DataFrame.unionByName, each) if each else None


def _replaced(spark: SparkSession, root: str, runs: list[str]) -> DataFrame:
    return spark.read.schema("run string, row long").parquet(*[f"{root}/{r}/replaced" for r in runs])


def append(docs: DataFrame, root: str, key: str = "doc_id", column: str = "text") -> int:
    """Index docs (key, column); the new version. Documents that the index has under the same keys are replaced."""
    spark = docs.sparkSession
    base, run = _last(spark, root), f"run-{uuid.uuid4().hex}"
    runs = _runs(spark, root, None)
    stage = scratch_dir(spark, "index-tokens")
    # row numbers are made once
    docs.where(F.col(key).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), search_tokens(F.col(column)).alias("tokens")).write.parquet(stage)
    made = spark.read.parquet(stage)
    write_ranges(made.select("row", "key"), f"{root}/{run}/documents", "row")
    postings = made.select(F.explode("tokens").alias("token"), "row")
    _write_postings(postings, postings.groupBy("token").agg(F.count("*").alias("total")), f"{root}/{run}/postings")
    earlier = _documents(spark, root, runs)
    if earlier is None:
        replaced = spark.createDataFrame([], "run string, row long")
    else:
        replaced = earlier.join(made.select("key"), "key", "left_semi").select("run", "row")
    replaced.write.parquet(f"{root}/{run}/replaced")
    return _publish(spark, root, base, [*runs, run])


def merge(spark: SparkSession, root: str) -> int:
    """All runs as one, without replaced documents; the new version. Texts aren't read again."""
    base, runs = _last(spark, root), _runs(spark, root, None)
    if len(runs) < 2:
        return base
    run = f"run-{uuid.uuid4().hex}"
    stage = scratch_dir(spark, "index-rows")
    live = _documents(spark, root, runs).join(_replaced(spark, root, runs), ["run", "row"], "left_anti")
    live.select("run", F.col("row").alias("old"), "key").repartition("run", "old").withColumn("row", F.monotonically_increasing_id()).write.parquet(stage)
    numbered = spark.read.parquet(stage)
    write_ranges(numbered.select("row", "key"), f"{root}/{run}/documents", "row")
    blocks = reduce(DataFrame.unionByName, [read_all(spark, f"{root}/{r}/postings").select("token", "n", "rows", F.lit(r).alias("run")) for r in runs])
    postings = blocks.select("token", F.explode("rows").alias("old"), "run").join(numbered, ["run", "old"]).select("token", "row")
    # replaced documents are counted too
    _write_postings(postings, blocks.groupBy("token").agg(F.sum("n").alias("total")), f"{root}/{run}/postings")
    spark.createDataFrame([], "run string, row long").write.parquet(f"{root}/{run}/replaced")
    return _publish(spark, root, base, [run])


def clean(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Delete all but the last `keep` versions, and the runs that only they had."""
    there = commits.versions(spark, root)
    used = {r for v in there[-keep:] for r in _runs(spark, root, v)}
    for v in there[:-keep]:
        for r in set(_runs(spark, root, v)) - used:
            commits.delete(spark, f"{root}/{r}")
        commits.delete(spark, f"{root}/commits/{v:012}.json")


def tokens_of(words: list[str]) -> list[str]:
    """The tokens that documents are indexed by."""
    return sorted({t for w in words for t in re.split("[^a-z0-9_]+", w.lower())} - {"", *STOP_WORDS})


def blocks_of(spark: SparkSession, root: str, words: list[str], version: int | None = None) -> DataFrame | None:
    """(run, token, low, high, n, rows): the blocks of the words' tokens; None without a run."""
    each = [read_values(spark, f"{root}/{r}/postings", "token", tokens_of(words)).withColumn("run", F.lit(r)) for r in _runs(spark, root, version)]
    return reduce(DataFrame.unionByName, each) if each else None


def near_blocks(blocks: DataFrame, rare: str) -> DataFrame:
    """The blocks of the token `rare`, and those of the others that may hold one of its rows."""
    own = blocks.where(F.col("token") == rare)
    others = blocks.where(F.col("token") != rare).withColumn("block", _block(F.col("low")))
    one = F.col("block") == _block(F.col("high"))
    there = own.select("run", F.explode(F.transform("rows", _block)).alias("block")).distinct()
    return own.unionByName(others.where(~one).drop("block")).unionByName(others.where(one).join(there, ["run", "block"], "left_semi").drop("block"))


def search(spark: SparkSession, root: str, words: list[str], version: int | None = None) -> DataFrame:
    """(key): documents that have all the words, as of a version or now. Words without a token find nothing."""
    tokens, runs = tokens_of(words), _runs(spark, root, version)
    blocks = blocks_of(spark, root, words, version)
    counts = {r["token"]: r["n"] for r in blocks.groupBy("token").agg(F.sum("n").alias("n")).collect()} if tokens and runs else {}
    if not tokens or len(counts) < len(tokens):
        kind = read_all(spark, f"{root}/{runs[0]}/documents").schema["key"].dataType.simpleString() if runs else "string"
        return spark.createDataFrame([], f"key {kind}")
    near = near_blocks(blocks, min(tokens, key=lambda t: (counts[t], t))) if len(tokens) > 1 else blocks
    rows = near.select("run", F.explode("rows").alias("row")).groupBy("run", "row").agg(F.count("*").alias("n")).where(F.col("n") == len(tokens))
    live = rows.join(_replaced(spark, root, runs), ["run", "row"], "left_anti")
    return live.join(_documents(spark, root, runs), ["run", "row"]).select("key").distinct()


def token_counts(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(token, n): documents that have it, replaced ones left out. Blocks are opened where a run has replaced documents only."""
    runs = _runs(spark, root, version)
    gone = _replaced(spark, root, runs)
    touched = {r["run"] for r in gone.select("run").distinct().collect()}  # runs of the version
    parts = []
    for r in runs:
        blocks = read_all(spark, f"{root}/{r}/postings")
        if r in touched:
            own = gone.where(F.col("run") == r).select("row")
            parts.append(blocks.select("token", F.explode("rows").alias("row")).join(own, "row", "left_anti").select("token", F.lit(1).alias("n")))
        else:
            parts.append(blocks.select("token", "n"))
    return reduce(DataFrame.unionByName, parts).groupBy("token").agg(F.sum("n").alias("n"))
