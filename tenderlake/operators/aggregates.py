"""Counts, duplicates and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from .windows import flag_inserts

#: Places in one list, at most.
CHUNK = 10_000


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows)."""
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def occurrences(df: DataFrame, key: str, at: str = "page_num") -> DataFrame:
    """(key, pages): every place of a key, in order."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(at)).alias("pages"))


def duplicates(df: DataFrame, key: str, at: str = "page_num") -> DataFrame:
    """Keys that occur more than once. Counted before the places are gathered, so unique keys gather nothing."""
    often = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    return occurrences(df.join(often, key, "left_semi"), key, at)


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    """(key, n, places): one row for each duplicate key, its places as JSON in order."""
    often = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    places = F.array_sort(F.collect_list(F.struct("page_num", "pos")))
    return df.join(often, key, "left_semi").groupBy(key).agg(F.count("*").alias("n"), F.to_json(places).alias("places"))


def _ranked(df: DataFrame, key: str, at: list[str]) -> DataFrame:
    """(key, _at, _rank, _n): each row's rank among its key's in order of `at`, from 0, and their number. Ranges of (key, at) are ranked apart, written once, and moved by what earlier ranges have of the key, so no key is one task."""
    spark = df.sparkSession
    placed = df.select(F.col(key), F.struct(*at).alias("_at"))
    numbered = placed.repartitionByRange(key, "_at").sortWithinPartitions(key, "_at").withColumn("_id", F.monotonically_increasing_id())
    path = scratch_dir(spark, "ranked")
    numbered.write.parquet(path)
    own = spark.read.schema(numbered.schema).parquet(path).withColumn("_part", F.shiftright("_id", 33))
    # a row for each key and range that has it
    ends = own.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_range")).agg(F.min("_id").alias("_low"), F.count("*").alias("_rows"))
    of_key = Window.partitionBy("_key")
    before = F.coalesce(F.sum("_rows").over(of_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ends.select("_key", "_range", (before - F.col("_low")).alias("_shift"), F.sum("_rows").over(of_key).alias("_n"))
    met = own.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_range")))
    return met.select(key, "_at", (F.col("_id") + F.col("_shift")).alias("_rank"), "_n")


def occurrence_chunks(df: DataFrame, key: str, at: str = "page_num", most: int = CHUNK, least: int = 1) -> DataFrame:
    """(key, chunk, n, pages): every place of a key that has `least` of them or more, in order, `most` in a list at most; chunk counts from 0, n is the key's number of places."""
    rows = _ranked(df, key, [at]).where(F.col("_n") >= least)
    lists = rows.groupBy(key, F.floor(F.col("_rank") / most).alias("chunk")).agg(F.max("_n").alias("n"), F.array_sort(F.collect_list(F.col("_at")[at])).alias("pages"))
    return lists.select(key, "chunk", "n", "pages")


def report_chunks(df: DataFrame, key: str, most: int = CHUNK) -> DataFrame:
    """(key, chunk, n, places): as duplicate_report, with `most` places in a row at most."""
    rows = _ranked(df, key, ["page_num", "pos"]).where("_n > 1")
    lists = rows.groupBy(key, F.floor(F.col("_rank") / most).alias("chunk")).agg(F.max("_n").alias("n"), F.to_json(F.array_sort(F.collect_list("_at"))).alias("places"))
    return lists.select(key, "chunk", "n", "places")


def duplicate_ratio(df: DataFrame, key: str) -> DataFrame:
    """(n_unique, n_duplicated, percent): percent of the unique keys that occur more than once, null for no keys."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    twice = F.count_if(F.col("_n") > 1)
    return counts.agg(F.count("*").alias("n_unique"), twice.alias("n_duplicated"), F.round(100.0 * twice / F.nullif(F.count("*"), F.lit(0)), 1).alias("percent"))


def contract_quantity(items: DataFrame, key: str = "contract_number") -> DataFrame:
    return items.groupBy(key).agg(F.sum(F.coalesce("quantity", F.lit(0))).alias("total_quantity"))


def redundant_pages(log: DataFrame, key: str, seq: str) -> DataFrame:
    """(page_num): pages where no row was the first sighting of its key."""
    return flag_inserts(log, key, seq).groupBy("page_num").agg(F.max(F.col("is_insert").cast("int")).alias("_new")).where("_new = 0").select("page_num")


def run_summary(outcomes: DataFrame, outcome: str = "outcome") -> DataFrame:
    """(scraped, downloaded, skipped, failed)."""
    count = lambda value: F.count_if(F.col(outcome) == value)
    return outcomes.agg(F.count("*").alias("scraped"), count("downloaded").alias("downloaded"), count("skipped").alias("skipped"), count("failed").alias("failed"))
