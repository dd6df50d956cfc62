"""Cleaning of whole tables, and the search index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators.rows import split_valid

ROLES = {
    "contact": text.repair_phone,
    "total": text.repair_number,
    "tax_id": text.tax_id,
    "email": lambda c: F.trim(F.element_at(F.split(F.trim(c), "\n"), 1)),
    "text": text.clean_value,
}


def clean_corpus(docs: DataFrame, flatten: bool = False) -> DataFrame:
    """docs with `cleaned`: lines squeezed and cleaned, or all on one line."""
    clean = text.full_clean if flatten else text.layout_clean
    return docs.withColumn("cleaned", clean(text.normal_lines(F.col("text"))))


def audit_text(docs: DataFrame) -> DataFrame:
    """Texts beside their ASCII form."""
    return docs.select("doc_id", "text", text.ascii_squeeze(F.col("text")).alias("cleaned"))


def clean_fields(records: DataFrame, roles: dict[str, str]) -> DataFrame:
    return records.withColumns({c: ROLES[role](F.col(c)) for c, role in roles.items()})


def type_tables(contracts: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contracts and items with text columns as decimals, times and integers, and the rows that fail: (table_name, contract_number, reason, row), row being the texts as JSON. Null and empty texts are null, not failures."""
    kinds = {"contract_date": dates.contract_time, "total_value": text.decimal_of, "quantity": lambda c: c.try_cast("int"), "price": text.decimal_of}
    good, bad = [], []
    for name, df in (("contracts", contracts), ("items", items)):
        own = [c for c in df.columns if c in kinds]
        whole = df.withColumns({f"_{c}": F.nullif(F.trim(c), F.lit("")) for c in own} | {"_row": F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))})
        rules = {c: F.col(f"_{c}").isNull() | kinds[c](F.col(f"_{c}")).isNotNull() for c in own}
        fine, failed = split_valid(whole, rules)
        good.append(fine.select(*[kinds[c](F.col(f"_{c}")).alias(c) if c in own else F.col(f"`{c}`") for c in df.columns]))
        bad.append(failed.select(F.lit(name).alias("table_name"), "contract_number", "reason", F.col("_row").alias("row")))
    return good[0], good[1], bad[0].union(bad[1])


def build_index(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(token, key): a row for each distinct token of a document. Sorted files by token serve lookups; no list of a token's documents is gathered."""
    return docs.select(F.explode(text.search_tokens(F.col(column))).alias("token"), key)


def search_index(index: DataFrame, words: list[str], key: str = "doc_id") -> DataFrame:
    """Keys that have all the words."""
    wanted = sorted({w.lower() for w in words})
    return index.where(F.col("token").isin(wanted)).groupBy(key).agg(F.countDistinct("token").alias("_n")).where(F.col("_n") == len(wanted)).select(key)
