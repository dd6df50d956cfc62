"""Projections, filters, row quality, ordering and set operations."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_dir


def conform(df: DataFrame, columns: list[str], types: dict[str, str] | None = None, include: tuple[list[str], ...] = ()) -> DataFrame:
    """Those columns in that order: missing ones null, others dropped; include: optional groups that follow."""
    types = types or {}
    wanted = [*columns, *(c for group in include for c in group)]
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(types.get(c) or (df.schema[c].dataType if c in df.columns else "string")).alias(c) for c in wanted])


def stringify(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns})


def filter_records(df: DataFrame, date: str, from_date=None, to_date=None, contains: dict[str, str] | None = None, **equal) -> DataFrame:
    """All the criteria that aren't empty: a range of days, both included, on the raw column; substrings; values."""
    tests: list[Column] = []
    if from_date:
        tests.append(F.col(date) >= F.lit(from_date).cast("timestamp_ntz"))
    if to_date:
        tests.append(F.col(date) < F.date_add(F.lit(to_date).cast("date"), 1).cast("timestamp_ntz"))
    tests += [F.contains(F.lower(F.col(c)), F.lit(v.lower())) for c, v in (contains or {}).items() if v]
    tests += [F.col(c) == v for c, v in equal.items() if v not in (None, "")]
    return df.where(reduce(and_, tests)) if tests else df


def matches_any(term: str, columns: list[str]) -> Column:
    """Whether any column contains the term, whatever the case; % and _ are plain characters."""
    return reduce(or_, [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(term.lower())), F.lit(False)) for c in columns])


def search_any(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    return df.where(matches_any(term, columns))


def search_text(columns: list[str]) -> Column:
    """Fields joined by a space, null as nothing."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the others with `reason`: the first rule, in order, that doesn't hold."""
    reason = F.coalesce(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    judged = df.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def first_n(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)


def page_of(df: DataFrame, page: int, *order, size: int = 10) -> DataFrame:
    """Page `page`, from 1, of the rows in that order."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def combine(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def page_overlap(log: DataFrame, a: int, b: int, key: str = "b_id") -> DataFrame:
    """Keys on both pages."""
    on = lambda n: log.where(F.col("page_num") == n).select(key)
    return on(a).intersect(on(b))


def page_overlaps(log: DataFrame, key: str = "b_id", within: int = 5) -> DataFrame:
    """(a, b, common): distinct keys that pages up to `within` apart share. A pair is found through windows of pages, so no key pairs all its pages."""
    once = log.select("page_num", key).distinct()
    near = F.explode(F.sequence(F.col("page_num") + 1, F.col("page_num") + within)).alias("page_num")
    ahead = once.select(F.col("page_num").alias("a"), key, near)
    return ahead.join(once, ["page_num", key]).groupBy("a", F.col("page_num").alias("b")).agg(F.count("*").alias("common"))


def shared_keys(log: DataFrame, key: str = "b_id") -> DataFrame:
    """(page_num, keys, shared, meetings) over all pairs of pages, without naming them: a page's distinct keys, those that any other page has too, and the sum of what it has in common with each other page. Rows without a key don't count."""
    once = log.where(F.col(key).isNotNull()).select("page_num", key).distinct()
    pages = once.groupBy(key).agg(F.count("*").alias("_pages"))
    others = F.col("_pages") - 1
    return once.join(pages, key).groupBy("page_num").agg(F.count("*").alias("keys"), F.count_if(others > 0).alias("shared"), F.sum(others).alias("meetings"))


def plan_pages(spark: SparkSession, total: int, size: int = 10, cap: int | None = None, compat: bool = False) -> DataFrame:
    """(page_num): pages 2 to the last; page 1 told the total. compat: total // size + 1 pages."""
    last = total // size + 1 if compat else -(-total // size)
    last = min(last, cap) if cap else last
    return spark.range(2, max(last, 1) + 1).withColumnRenamed("id", "page_num")


def number_pages(df: DataFrame, *order, size: int = 10) -> DataFrame:
    """Every row with its page, in one ordering; rows that tie in it are in any order. Ranges are numbered apart and written in the shared folder, so that their numbers are made once; then they are moved by the rows before them."""
    spark = df.sparkSession
    placed = df.select("*", F.struct(*order).alias("_key"))
    # partition and row in it, in one number
    numbered = placed.repartitionByRange("_key").sortWithinPartitions("_key").withColumn("_id", F.monotonically_increasing_id()).drop("_key")
    path = scratch_dir(spark, "numbered")
    numbered.write.parquet(path)
    part, n = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    own = spark.read.schema(numbered.schema).parquet(path).withColumns({"_part": part, "_n": n})
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = own.groupBy("_part").agg(F.count("*").alias("_rows")).withColumn("_before", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)))
    # a row for each partition
    return own.join(F.broadcast(before), "_part").withColumn("page_num", F.floor((F.col("_before") + F.col("_n")) / size) + 1).drop("_part", "_n", "_id", "_rows", "_before")


#: Rows of a task that gathers keys; Spark sorts what a task gathers, in memory as far as it goes.
ROWS_A_TASK = 500_000


def by_key(df: DataFrame, *keys: str, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """df, written once, in partitions by the keys whose number follows the rows', so that a task's sort doesn't grow with df."""
    spark = df.sparkSession
    path = scratch_dir(spark, "rows")
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    return made.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-made.count() // rows_a_task)), *keys)
