"""Keyed state: what is left of a key after all its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import by_key


def upsert(log: DataFrame, key: str, seq: str, last_wins: tuple[str, ...]) -> DataFrame:
    """One row a key: columns of last_wins take the value of its last row by seq, others that of its first."""
    others = [c for c in log.columns if c not in (key, seq)]
    ends = log.groupBy(key).agg(F.min_by(F.struct(*others), seq).alias("_first"), F.max_by(F.struct(*others), seq).alias("_last"))
    return ends.select(key, *[F.col(f"_last.{c}" if c in last_wins else f"_first.{c}").alias(c) for c in others])


def upsert_batch(state: DataFrame, new: DataFrame, key: str, seq: str, last_wins: tuple[str, ...]) -> DataFrame:
    """State (without seq) and a batch of observations folded into the next state."""
    ranked = new.withColumn("_rank", F.struct(F.lit(1).alias("later"), F.col(seq).alias("at"))).drop(seq)
    at = new.schema[seq].dataType
    old = state.withColumn("_rank", F.struct(F.lit(0).alias("later"), F.lit(None).cast(at).alias("at")))
    return upsert(old.unionByName(ranked, allowMissingColumns=True), key, "_rank", last_wins)


def _dimension(rows: DataFrame, key: str, attribute: str, surrogate: str, others: tuple[str, ...] = ()) -> DataFrame:
    known = rows.where(F.col(key).isNotNull() & (F.col(key) != "")).select(key, "seq", attribute, *others)
    return upsert(known, key, "seq", (attribute,)).withColumn(surrogate, F.xxhash64(key))


def build_dims(extracts: DataFrame) -> dict[str, DataFrame]:
    """Organisations, buyers and sellers of extracted contracts: one attribute takes the last value, the rest the first; rows without a key are skipped."""
    return {
        "organisations": _dimension(extracts, "org_name", "org_type", "org_id", ("ministry",)),
        "buyers": _dimension(extracts, "buyer_email", "buyer_designation", "buyer_id", ("buyer_contact",)),
        "sellers": _dimension(extracts, "seller_id", "company_name", "seller_key"),
    }


def load_contracts(state: DataFrame, new: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contracts of `new` that aren't in state (the first of each number), and the items of those only."""
    fresh = new.join(state.select("contract_number"), "contract_number", "left_anti")
    others = [c for c in fresh.columns if c not in ("contract_number",)]
    first = fresh.groupBy("contract_number").agg(F.min_by(F.struct(*others), "seq").alias("r")).select("contract_number", "r.*")
    return first.select(*fresh.columns), items.join(first.select("contract_number"), "contract_number", "left_semi")


def classify_attempts(attempts: DataFrame) -> DataFrame:
    """(page_num, attempt, ok) -> (page_num, attempts, state): done after a success, else retry below three failures, else dead."""
    tries = attempts.groupBy("page_num").agg(F.max("attempt").alias("attempts"), F.bool_or("ok").alias("ok"))
    return tries.select("page_num", "attempts", F.when(F.col("ok"), "done").when(F.col("attempts") < 3, "retry").otherwise("dead").alias("state"))


def merge_sources(text: DataFrame, tables: DataFrame, positional: DataFrame, total: DataFrame, columns: list[str], fallback: tuple[str, ...] = ("Seller_ContactNo", "Seller_EmailID")) -> DataFrame:
    """A document a row: table values over text values; positional ones where both are empty; the text's total over the table's."""
    own = lambda df, tag: df.select(*[F.col(c).alias(c if c == "doc_id" else f"{tag}_{c}") for c in df.columns])
    joined = own(text, "text")
    for df, tag in ((tables, "table"), (positional, "positional"), (total, "total")):
        joined = joined.join(own(df, tag), "doc_id", "left")
    return _in_order(joined, columns, fallback)


def merge_read(read: DataFrame, tables: DataFrame, columns: list[str], fallback: tuple[str, ...] = ("Seller_ContactNo", "Seller_EmailID")) -> DataFrame:
    """`merge_sources` where all that texts say is in one row a document, as extraction.read_texts has it: one join."""
    return _in_order(read.join(tables.select(*[F.col(c).alias(c if c == "doc_id" else f"table_{c}") for c in tables.columns]), "doc_id", "left"), columns, fallback)


def _in_order(joined: DataFrame, columns: list[str], fallback: tuple[str, ...]) -> DataFrame:
    out = []
    for c in columns:
        order = ["total", "table", "text", *(["positional"] if c in fallback else [])]
        out.append(F.coalesce(*[F.nullif(f"{tag}_{c}", F.lit("")) for tag in order if f"{tag}_{c}" in joined.columns], F.lit(None).cast("string")).alias(c))
    return joined.select("doc_id", *out)


def merge_cells(pairs: DataFrame) -> DataFrame:
    """(doc_id, column, value, page_no, table_no, row_no, col_no) -> the last cell's value of each field."""
    return by_key(pairs, "doc_id").groupBy("doc_id", "column").agg(F.max_by("value", F.struct("page_no", "table_no", "row_no", "col_no")).alias("value"))
