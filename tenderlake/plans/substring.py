"""Substring search through an index of trigrams.

Rows are stored in blocks of BLOCK, in order of a key. Of each trigram of the lower-cased columns a
bitmap tells the blocks that have it; the bitmaps of a term's trigrams, and-ed, leave the blocks that
may have the term, and only these are read and verified. Terms below three characters are looked for
in all blocks. % and _ are plain characters, whatever their case letters match, and a null column has
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import matches_any
from ..session import scratch_dir
from ..sources.ranges import read_all, read_values, write_ranges

BLOCK_BITS = 12
#: Blocks up to which their numbers are given to the scan; beyond, rows meet them by a join.
LISTED = 10_000


def trigrams(c: Column) -> Column:
    """The distinct runs of three characters of a text in lower case."""
    letters = F.split(F.lower(c), "")
    n = F.size(letters)
    from_ = lambda k: F.slice(letters, k, n - 2)
    both = lambda x, y: F.concat(x, y)
    three = F.zip_with(F.zip_with(from_(1), from_(2), both), from_(3), both)
    return F.when(c.isNull() | (n < 3), F.array().cast("array<string>")).otherwise(F.array_distinct(three))


def build(df: DataFrame, root: str, columns: list[str], key: str, block_bits: int = BLOCK_BITS, files: int | None = None) -> None:
    """Store df in order of key, with an index of the columns."""
    spark = df.sparkSession
    stage = scratch_dir(spark, "substring-rows")
    ranged = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    ranged.sortWithinPartitions(key).withColumn("_block", F.shiftright(F.monotonically_increasing_id(), block_bits)).write.parquet(stage)
    rows = spark.read.parquet(stage)
    write_ranges(rows, f"{root}/rows", "_block", key, files=files)
    blocks = rows.groupBy("_block").agg(F.count("*").alias("n"))
    blocks.write.parquet(f"{root}/blocks")
    found = rows.select("_block", F.explode(F.array_distinct(F.flatten(F.array(*[trigrams(F.col(c)) for c in columns])))).alias("trigram")).distinct()
    bits = found.groupBy("trigram", F.bitmap_bucket_number("_block").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_block")).alias("bits"))
    write_ranges(bits, f"{root}/trigrams", "trigram", "bucket", files=files)


def blocks_for(spark: SparkSession, root: str, term: str) -> DataFrame:
    """(_block): the blocks that may have the term."""
    blocks = spark.read.parquet(f"{root}/blocks").select("_block")
    low = term.lower()
    wanted = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if not wanted:
        return blocks
    maps = read_values(spark, f"{root}/trigrams", "trigram", wanted)
    both = maps.groupBy("bucket").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits")).where(F.col("n") == len(wanted)).select("bucket", "bits")
    place = F.bitmap_bit_position("_block")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = blocks.withColumn("bucket", F.bitmap_bucket_number("_block")).join(both, "bucket")
    return there.where(F.getbit(byte, (place % 8).cast("int")) == 1).select("_block")


def search(spark: SparkSession, root: str, term: str, columns: list[str], listed: int = LISTED) -> DataFrame:
    """The stored rows in which one of the columns contains the term."""
    near = blocks_for(spark, root, term)
    first = [r["_block"] for r in near.limit(listed + 1).collect()]
    if len(first) <= listed:
        rows = read_values(spark, f"{root}/rows", "_block", first)
    else:
        rows = read_all(spark, f"{root}/rows").join(near, "_block", "left_semi")
    return rows.where(matches_any(term, columns)).drop("_block")
