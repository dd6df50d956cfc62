"""Lookups against ledgers, dimensions and the label dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import matches_any


#: Columns of a contract and its dimensions in which a search looks. Buyers have no name: they are searched by address and designation.
SEARCHED = ["contract_number", "org_name", "buyer_email", "buyer_designation", "company_name"]


def contract_names(contracts: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Contracts with what a search looks in, and shows."""
    return resolve_keys(contracts, tables).select(*SEARCHED, "contract_date", "total_value")


def shown_contracts(found: DataFrame, n: int) -> DataFrame:
    """The first n by number, as a search shows them."""
    return found.select("contract_number", F.date_format("contract_date", "dd-MM-yyyy").alias("contract_day"), "total_value", "org_name", "buyer_designation", "company_name").orderBy("contract_number").limit(n)


def search_contracts(tables: dict[str, DataFrame], term: str, n: int = 20) -> DataFrame:
    """Contracts with their organisation, buyer and seller, where the term is in any name; the first n by number."""
    return shown_contracts(contract_names(tables["contracts"], tables).where(matches_any(term, SEARCHED)), n)


def resolve_keys(contracts: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Contracts with the attributes and keys of their dimensions; a missing key leaves nulls. Spark broadcasts a dimension if its size allows."""
    return (
        contracts.join(tables["organisations"].select("org_name", F.col("org_id"), F.col("org_type").alias("current_org_type")), "org_name", "left")
        .join(tables["buyers"].select("buyer_email", "buyer_id", "buyer_designation"), "buyer_email", "left")
        .join(tables["sellers"].select("seller_id", "seller_key", "company_name"), "seller_id", "left")
    )


def pending(listed: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Listed keys that aren't in the ledger, once each."""
    return listed.select(key).distinct().join(ledger.select(key), key, "left_anti")


def resume(plan: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Planned pages that remain, and one row (planned, skipped, remaining)."""
    left = plan.join(done.select("page_num"), "page_num", "left_anti")
    counted = plan.join(done.select("page_num").distinct().withColumn("_done", F.lit(1)), "page_num", "left")
    return left, counted.agg(F.count("*").alias("planned"), F.count("_done").alias("skipped"), (F.count("*") - F.count("_done")).alias("remaining"))


def verify_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Every supplied key with whether the table has it."""
    there = df.select(key).distinct().withColumn("_there", F.lit(True))
    return keys.select(key).distinct().join(there, key, "left").select(key, F.coalesce("_there", F.lit(False)).alias("found"))


def similarity(a, b):
    """1 less the share of the longer string that Levenshtein's edits make up."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


#: Dictionary rows up to which each label is held against the whole dictionary; beyond, both meet by shared pieces.
SMALL_DICTIONARY = 10_000


def _by_pieces(rest: DataFrame, known: DataFrame, label: str, threshold: float) -> DataFrame:
    """(label, norm_label) pairs that may be that similar. Of a word cut into one piece more than the edits allowed, one piece at least stands unchanged in the other word."""
    length = F.length("norm_label")
    cuts = F.floor(length * (1 - threshold) / threshold + 1e-9) + 1
    at = lambda i: F.floor(i * length / cuts).cast("int")
    piece = lambda i: F.substring(F.col("norm_label"), at(i) + 1, at(i + 1) - at(i))
    entries = known.where(length > 0).select("norm_label", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), cuts - 1), piece))).alias("_piece"))
    # a piece is no longer than this
    widest = known.agg(F.max(F.ceil(length / cuts))).first()[0] or 1
    n = F.length(label)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(int(widest)))), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col(label), i, k))))
    asked = rest.where(n > 0).select(label, F.explode(F.array_distinct(runs)).alias("_piece"))
    near = F.least(n, length) >= threshold * F.greatest(n, length) - 1e-9
    return asked.join(entries, "_piece").where(near).select(label, "norm_label").distinct()


def match_labels(df: DataFrame, dim: DataFrame, label: str = "norm_label", threshold: float | None = None, small: int = SMALL_DICTIONARY, others: tuple[str, ...] = (), margin: float = 0.0) -> DataFrame:
    """df with matched_label: the dictionary's label of that normal form, the first by fill_order on a tie. threshold: labels without one get the most similar entry, if its similarity is that or more; each distinct label is compared once.

    others: normal forms of labels that stand for nothing in the dictionary; a label that is as near to
    one of them as to its best entry, or by less than the margin farther, has no match.
    A dictionary of at most `small` rows, which are counted, is sent whole to all tasks; in a larger
    one, labels and entries meet by the pieces that they share.
    """
    exact = dim.groupBy(F.col("norm_label").alias(label)).agg(F.min_by("label", "fill_order").alias("matched_label"))
    if threshold is None:
        return df.join(exact, label, "left")
    known = dim.groupBy("norm_label").agg(F.min("fill_order").alias("fill_order"), F.min_by("label", "fill_order").alias("entry"))
    rest = df.select(label).where(F.col(label).isNotNull()).distinct().join(exact, label, "left_anti")
    score = lambda e: F.round(similarity(F.col(label), e), 12)
    if known.count() <= small:
        entries = known.agg(F.collect_list(F.struct("norm_label", "fill_order", "entry")).alias("entries"))
        likeness = F.transform("entries", lambda e: F.struct((-score(e["norm_label"])).alias("s"), e["fill_order"].alias("o"), e["entry"].alias("entry")))
        # one row, of `small` entries at most
        best = rest.join(F.broadcast(entries)).select(label, F.array_min(likeness).alias("best")).where(F.col("best.s") <= -threshold).select(label, F.col("best.entry").alias("matched_label"), (-F.col("best.s")).alias("s"))
    else:
        pairs = _by_pieces(rest.select(F.col(label).alias("_label")), known, "_label", threshold).join(known, "norm_label")
        scored = pairs.select(F.col("_label").alias(label), "fill_order", "entry", F.round(similarity(F.col("_label"), F.col("norm_label")), 12).alias("s")).where(F.col("s") >= threshold)
        best = scored.groupBy(label).agg(F.min_by("entry", F.struct(-F.col("s"), "fill_order")).alias("matched_label"), F.max("s").alias("s"))
    if others:
        nearest = F.greatest(*[score(F.lit(x)) for x in others]) if len(others) > 1 else score(F.lit(others[0]))
        best = best.where((F.col("s") > nearest) & (F.col("s") >= nearest + margin))
    return df.join(exact.unionByName(best.drop("s")), label, "left")
