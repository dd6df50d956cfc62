"""A stored ledger of page attempts: what is done, to be tried again, dead, or claimed by a rescrape.

Attempts count from 0, and a page that fails with the attempt RETRIES is dead. A rescrape claims the
dead pages, tries them anew, and settles: pages that succeeded are done, the others dead again. Each
step is a commit (sources.commits) that names the rows it adds, so a claim is taken by one run only, and
a run that dies between claim and settlement loses no page: its claim stays until it is released, and
then its pages are dead as before. A success counts whenever and by whomever it is told.

Pages without a number are left out. Rows that repeat change nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import commits

RETRIES = 3
_ROWS = "page_num long, attempt int, ok boolean, claim long, takes boolean"


def _entries(spark: SparkSession, root: str, version: int | None = None) -> list[dict]:
    said = commits.content(spark, root, version)
    return said["entries"] if said else []


def _last(spark: SparkSession, root: str) -> int:
    return (commits.versions(spark, root) or [0])[-1]


def _add(spark: SparkSession, root: str, entry: Callable[[int], dict]) -> int:
    """Publish one entry more, whatever others publish meanwhile; the version."""
    while True:
        base = _last(spark, root)
        if commits.publish(spark, root, base + 1, {"entries": [*_entries(spark, root, base or None), entry(base + 1)]}):
            return base + 1


def _write(rows: DataFrame, root: str) -> str:
    name = f"rows-{uuid.uuid4().hex}"
    rows.where("page_num is not null").selectExpr("cast(page_num as long) page_num", "cast(attempt as int) attempt", "cast(ok as boolean) ok", "cast(claim as long) claim", "takes").write.parquet(f"{root}/{name}")
    return name


def record(attempts: DataFrame, root: str) -> int:
    """Add attempts (page_num, attempt, ok) of a run that holds no claim."""
    name = _write(attempts.select("page_num", "attempt", "ok", F.lit(None).alias("claim"), F.lit(False).alias("takes")), root)
    return _add(attempts.sparkSession, root, lambda _: {"rows": name})


def states(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(page_num, state, claims): done, retry, dead or claimed, and how often the page was claimed; as of a version or now."""
    entries = _entries(spark, root, version)
    names = [e["rows"] for e in entries if "rows" in e]
    closed = [e["closes"] for e in entries if "closes" in e]
    rows = spark.read.schema(_ROWS).parquet(*[f"{root}/{n}" for n in names]) if names else spark.createDataFrame([], _ROWS)
    tried = ~F.col("takes")
    pages = rows.groupBy("page_num").agg(
        F.coalesce(F.bool_or(F.when(tried, F.col("ok"))), F.lit(False)).alias("ok"),
        F.max(F.when(tried & F.col("claim").isNull(), F.col("attempt"))).alias("first"),
        F.max(F.when(F.col("takes"), F.col("claim"))).alias("last"),
        F.max(F.when(tried & F.col("claim").isNotNull(), F.struct("claim", "attempt"))).alias("again"),
        F.count_distinct(F.when(F.col("takes"), F.col("claim"))).alias("claims"),
    )
    failed = (F.col("again.claim") == F.col("last")) & (F.col("again.attempt") >= RETRIES)
    over = F.coalesce(failed, F.lit(False)) | F.col("last").isin(closed)
    state = F.when(F.col("ok"), "done").when(F.col("last").isNull(), F.when(F.col("first") < RETRIES, "retry").otherwise("dead")).when(over, "dead").otherwise("claimed")
    return pages.select("page_num", state.alias("state"), "claims")


def claim(spark: SparkSession, root: str) -> int | None:
    """Take all dead pages; the claim's number, or None if there are none. Of two runs that claim at once, one gets each page."""
    while True:
        base = _last(spark, root)
        dead = states(spark, root, base or None).where("state = 'dead'").select("page_num", F.lit(None).alias("attempt"), F.lit(None).alias("ok"), F.lit(base + 1).alias("claim"), F.lit(True).alias("takes"))
        name = _write(dead, root)
        if spark.read.parquet(f"{root}/{name}").isEmpty():
            commits.delete(spark, f"{root}/{name}")
            return None
        if commits.publish(spark, root, base + 1, {"entries": [*_entries(spark, root, base or None), {"rows": name, "claims": base + 1}]}):
            return base + 1
        commits.delete(spark, f"{root}/{name}")


def claimed(spark: SparkSession, root: str, number: int) -> DataFrame:
    """(page_num): the pages of a claim."""
    name = next(e["rows"] for e in _entries(spark, root) if e.get("claims") == number)
    return spark.read.schema(_ROWS).parquet(f"{root}/{name}").select("page_num")


def settle(outcomes: DataFrame, root: str, number: int) -> int:
    """Tell what came of a claim's pages (page_num, attempt, ok) and close it: pages without a success are dead again. Outcomes of other pages don't count."""
    spark = outcomes.sparkSession
    own = outcomes.join(claimed(spark, root, number), "page_num", "left_semi")
    name = _write(own.select("page_num", "attempt", "ok", F.lit(number).alias("claim"), F.lit(False).alias("takes")), root)
    return _add(spark, root, lambda _: {"rows": name, "closes": number})


def release(spark: SparkSession, root: str, number: int) -> int:
    """Give back a claim whose run is gone."""
    return _add(spark, root, lambda _: {"closes": number})
