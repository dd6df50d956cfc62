"""Quality rules as a ledger of failure bits, with DataFrame functions alone.

Every rule is evaluated once. The ledger keeps, for each document, the measurements and one integer
whose bit k says that rule k failed, and is written. A policy is a versioned mask of rules: a document
fails it if its bits and the mask meet. Policies and ablations read the ledger's bits, never the texts.

Words are runs of characters other than \\x20 and \\x09-\\x0D. A null or empty text has no words, no
symbols and no lines, and fails the length rule. Rows that repeat are judged alike. Columns of docs
other than doc_id and text aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import staged

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]


#: Name -> failure, over the measurements; the bit is the place in this order. Shares are of words or lines.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "short_words": "word_chars < 2.5 * n_words",
    "long_words": "word_chars > 14 * n_words",
    "symbols": "n_symbols > 0.1 * n_words",
    "repeated_lines": "n_dup_lines > 0.7 * n_lines",
    "shouting": "n_upper > 0.5 * n_letters",
    "no_letters": "n_letters < 0.5 * word_chars",
}
BASE = Policy("base", ("too_few_words", "repeated_words"))
FIRST = Policy("v1", ("too_few_words", "repeated_words", "short_words", "long_words", "symbols"))
DEFAULT = Policy("v2", tuple(RULES))
POLICIES = (BASE, FIRST, DEFAULT)


def _let(value: Column, body) -> Column:
    """body of value, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words inside windows of `width` words that are found twice or more in the array, the first one too.

    Windows' hashes (64 bits) are sorted with their places; equal neighbours repeat. The places, in
    order, add the words that each covers beyond the one before. n log n in the words of a text.
    """
    n = F.size(words)
    hashes = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.struct(F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(width)]).alias("h"), i.alias("i")))
    twice = lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
    places = lambda s: F.array_sort(F.transform(twice(s), lambda x: x["i"]))
    covered = lambda p: F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - i, F.lit(width)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(n < width + 1, F.lit(0).cast("long")).otherwise(_let(F.array_sort(hashes(words)), lambda s: _let(places(s), covered)))


def measure(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id and the measurements that the rules read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    squeezed = docs.select("doc_id", text.alias("text"))
    words = F.filter(F.split("text", BLANKS), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return squeezed.select(
        "doc_id",
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        _without(F.col("text"), " \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
    ).select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "n_letters", "n_upper")


def ledger(docs: DataFrame) -> DataFrame:
    """docs -> doc_id, measurements, fail_bits: bit k is set where rule k of RULES fails."""
    bits = F.lit(0)
    for k, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)))
    return measure(docs).withColumn("fail_bits", bits)


def mask(policy: Policy) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in policy.rules)


def fails(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) != 0


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """Ledger rows with `kept` and the policy's version."""
    return rows.withColumn("kept", ~fails(policy)).withColumn("policy", F.lit(policy.version))


def write_ledger(docs: DataFrame) -> DataFrame:
    """The ledger of docs, written in the shared folder: what follows reads numbers, not texts."""
    return staged(ledger(docs), "quality-ledger")


def regained(rows: DataFrame, policy: Policy) -> DataFrame:
    """Ledger rows with `regained`: of a document that fails one rule of the policy only, the documents that the policy without that rule would keep again; else 0. Counts have a row for each pattern of bits."""
    own = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))
    single = [1 << list(RULES).index(r) for r in policy.rules]
    counts = rows.groupBy(own.alias("_bits")).agg(F.count("*").alias("_docs"))
    # 2 ** rules rows at most
    told = rows.withColumn("_bits", own).join(F.broadcast(counts), "_bits")
    return told.withColumn("regained", F.when(F.col("_bits").isin(single), F.col("_docs")).otherwise(F.lit(0))).drop("_bits", "_docs")


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """(rule, failed, failed_alone, kept_without): documents that fail each rule, fail it only, and that the policy without it keeps.

    Documents are counted by their bits first: what follows has a row for each pattern of bits at most.
    """
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("docs"))
    names = list(RULES)
    of = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).alias("bit")) for r in policy.rules])
    each = patterns.withColumn("rule", F.explode(of)).select("bits", "docs", "rule.*")
    one = F.col("bits").bitwiseAND(F.col("bit")) != 0
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("docs"))), F.lit(0)).alias
    return each.groupBy("rule").agg(count(one)("failed"), count(F.col("bits") == F.col("bit"))("failed_alone"), count((F.col("bits") == 0) | (F.col("bits") == F.col("bit")))("kept_without"))
