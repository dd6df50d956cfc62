"""Landed JSON pages of bid listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.variant import fields_of, value_or

FIELDS = [
    "id",
    "b_id",
    "b_bid_number",
    "b_category_name",
    "bd_category_name",
    "b_cat_id",
    "b_total_quantity",
    "b_status",
    "b_type",
    "b_eval_type",
    "final_start_date_sort",
    "final_end_date_sort",
    "ba_official_details_minName",
    "ba_official_details_deptName",
    "department_name",
]


def documents_of(body: str = "body") -> Column:
    """A page's list of documents; null where it has none."""
    return F.try_variant_get(F.try_parse_json(body), "$.response.response.docs", "array<variant>")


def _parsed(pages: DataFrame) -> DataFrame:
    envelope = F.try_parse_json("body")
    return pages.select("page_num", documents_of().alias("docs"), F.try_variant_get(envelope, "$.response.response.numFound", "long").alias("declared"))


def explode_pages(pages: DataFrame) -> DataFrame:
    """(page_num, body) -> (page_num, pos, doc): documents of the pages that have a list of them."""
    return _parsed(pages).select("page_num", F.posexplode("docs").alias("pos", "doc"))


def bad_pages(pages: DataFrame) -> DataFrame:
    """(page_num): pages without a list of documents."""
    return _parsed(pages).where("docs is null").select("page_num")


def completeness(pages: DataFrame, bids: DataFrame, key: str = "b_id") -> DataFrame:
    """(expected, landed, missing): the declared number of records against the distinct keys that landed."""
    said = _parsed(pages).agg(F.max("declared").alias("expected"))
    there = bids.agg(F.countDistinct(key).alias("landed"))
    # one row on each side
    return said.join(F.broadcast(there)).select("expected", "landed", F.greatest(F.col("expected") - F.col("landed"), F.lit(0)).alias("missing"))


def flatten_bids(docs: DataFrame, *beside: str) -> DataFrame:
    """A bid a row; the key is b_id, or the integer of `id` where that is 0 or missing. beside: columns that stay."""
    d = F.col("_fields")
    key = F.coalesce(F.nullif(value_or(d["b_id"], "long"), F.lit(0)), F.try_variant_get(d["id"], "$", "string").try_cast("long"))
    return docs.withColumn("_fields", fields_of(F.col("doc"), FIELDS)).select(
        "page_num",
        "pos",
        *beside,
        key.alias("b_id"),
        value_or(d["b_bid_number"], "string", "").alias("b_bid_number"),
        value_or(d["b_category_name"], "string", "").alias("b_category_name"),
        value_or(d["bd_category_name"], "string", "").alias("bd_category_name"),
        value_or(d["b_cat_id"], "string", "").alias("b_cat_id"),
        value_or(d["b_total_quantity"], "int", 0).alias("b_total_quantity"),
        value_or(d["b_status"], "int", 0).alias("b_status"),
        value_or(d["b_type"], "int", 0).alias("b_type"),
        value_or(d["b_eval_type"], "int", 0).alias("b_eval_type"),
        value_or(d["final_start_date_sort"], "timestamp_ntz").alias("final_start_date_sort"),
        value_or(d["final_end_date_sort"], "timestamp_ntz").alias("final_end_date_sort"),
        value_or(d["ba_official_details_minName"], "string", "").alias("ministry_name"),
        F.coalesce(value_or(d["ba_official_details_deptName"], "string"), value_or(d["department_name"], "string", "")).alias("department_name"),
    )
