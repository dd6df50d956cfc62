"""Landed documents, key ledgers and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, glob: str = "*.[tT][xX][tT]") -> DataFrame:
    """(doc_id, text): every file below path; the key is the file's stem, whatever the case of its suffix."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("doc_id"), F.col("value").alias("text"))


def join_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) -> (doc_id, text): pages in order, a newline between."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"])
    return pages.groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("text"))


def empty_documents(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNull() | (F.trim("text") == ""))


def read_keys(spark: SparkSession, path: str, numeric: bool = False) -> DataFrame:
    """(key): a key a line, trimmed, blanks dropped; numeric ledgers keep lines of digits only."""
    keys = spark.read.text(path).select(F.trim("value").alias("key")).where("key <> ''")
    return (keys.where(F.col("key").rlike("^[0-9]+$")).select(F.col("key").cast("long").alias("key")) if numeric else keys).distinct()


def extract_listing_ids(html: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """(key, pos, id): the ids that a listing's header links have as first quoted argument of their click attribute, in order."""
    return all_matches(html, CLICK_ID, key, column)


def all_matches(html: DataFrame, pattern: str, key: str = "page_id", column: str = "html") -> DataFrame:
    """(key, pos, id): the first group of each match, in order."""
    return html.select(key, F.posexplode(F.regexp_extract_all(column, F.lit(pattern), 1)).alias("pos", "id"))


#: In a listing, the first quoted argument of a header link's click attribute is the record's id.
CLICK_ID = r"""onclick=["'][^"'(]*\(\s*'([^']+)'"""


def extract_links(fragments: DataFrame, status: str = "status", html: str = "html", pattern: str = r"""href=\\?["']([^"'\\]+)""") -> DataFrame:
    """Rows with url and outcome: ok, no_url or bad_status; escaped quotes are taken, escaped slashes undone."""
    url = F.nullif(F.regexp_extract(F.replace(F.col(html), F.lit("\\/"), F.lit("/")), pattern, 1), F.lit(""))
    good = F.col(status) == "1"
    return fragments.withColumn("url", F.when(good, url)).withColumn("outcome", F.when(~good | F.col(status).isNull(), F.lit("bad_status")).when(url.isNull(), F.lit("no_url")).otherwise(F.lit("ok")))


def section(text: Column, start: str, end: str | None = None) -> Column:
    """What stands between two markers: '' without the first, all that follows without the second."""
    at = F.instr(text, start)
    rest = F.substring(text, at + len(start), F.length(text))
    if end is None:
        return F.when(at == 0, F.lit("")).otherwise(rest)
    to = F.instr(rest, end)
    return F.when(at == 0, F.lit("")).when(to == 0, rest).otherwise(F.trim(F.substring(rest, F.lit(1), to - 1)))
