"""Cleaning of text as column expressions: Column in, Column out, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: White space that squeezing changes: texts without any are left as they are, at no cost but a look.
UNEVEN = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
GLYPH = r"\(cid:\d+\)"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
DEVANAGARI = r"[ऀ-ॿ]+"
#: For classes of letters, digits and signs: Java looks up characters that are named one by one in a table, and tests a union of ranges by a chain of calls, which costs ten times as much.
LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
LETTERS = LOWER.upper() + LOWER

# Words that a search index leaves out.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, UNEVEN, " "))


def ascii_squeeze(c: Column) -> Column:
    """Without non-ASCII characters; one space for each run of white space; trimmed."""
    return squeeze(F.regexp_replace(c, r"[^\x00-\x7F]", ""))


def undouble_letters(c: Column) -> Column:
    """A token of three characters or more with two doubled runs or more that make up 30 % of it loses the doubles."""
    runs = F.regexp_count(c, F.lit(r"(.)\1+"))
    doubled = F.length(c) - F.length(F.regexp_replace(c, r"(.)\1+", ""))
    return F.when((F.length(c) >= 3) & (runs >= 2) & (doubled >= 0.3 * F.length(c)), F.regexp_replace(c, r"(.)\1+", "$1")).otherwise(c)


def _each_token(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, " "), lambda t: F.when(t.rlike(r"^\p{L}+$"), undouble_letters(t)).otherwise(t)), " ")


def full_clean(c: Column) -> Column:
    """One line: no glyph codes, control characters, repeated commas or runs of white space; letters undoubled by token."""
    bare = F.regexp_replace(F.regexp_replace(c, GLYPH, ""), CONTROL, "")
    return _each_token(squeeze(F.regexp_replace(bare, r",\s*,+", ",")))


def layout_clean(c: Column) -> Column:
    """As full_clean, line by line, but for commas and white space."""
    bare = F.regexp_replace(F.regexp_replace(c, GLYPH, ""), CONTROL, "")
    return F.array_join(F.transform(F.split(bare, "\n"), _each_token), "\n")


def normal_lines(c: Column) -> Column:
    """Lines squeezed, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), squeeze), lambda x: x != ""), "\n")


def clean_value(c: Column) -> Column:
    """Squeezed, with glyph codes and Devanagari as white space."""
    bare = F.when(F.contains(c, F.lit("(cid:")), F.regexp_replace(c, GLYPH, " ")).otherwise(c)
    return F.trim(F.regexp_replace(bare, r"[ऀ-ॿ\x20\x09-\x0D]{2,}|[ऀ-ॿ\x09-\x0D]", " "))


def normal_label(c: Column) -> Column:
    """Letters and digits of a label in lower case; doubles collapsed where there are two or more."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), "।", " "), GLYPH, ""), "[^a-z0-9]", "")
    return F.when(F.regexp_count(bare, F.lit(r"(.)\1+")) >= 2, F.regexp_replace(bare, r"(.)\1+", "$1")).otherwise(bare)


def english_label(c: Column) -> Column:
    """What follows the last bar of a bilingual label."""
    return F.trim(F.substring_index(c, "|", -1))


def digit_segments(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[,.\s]+"), lambda x: F.regexp_replace(x, "[^0-9]", "")), lambda x: x != "")


def repair_number(c: Column, mode: str = "digits", longest: int = 10, tail: int = 5) -> Column:
    """mode digits: all digits. mode last_segment: the last segment of 2 to `longest` digits, else the last of `longest` at most, else the last `tail` digits of the longest. No leading zeros; null without digits."""
    if mode == "digits":
        raw = F.regexp_replace(c, "[^0-9]", "")
    else:
        parts = digit_segments(c)
        last = lambda low: F.try_element_at(F.filter(parts, lambda x: (F.length(x) >= low) & (F.length(x) <= longest)), F.lit(-1))
        widest = F.array_max(F.transform(parts, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
        raw = F.coalesce(last(2), last(1), F.right(widest, F.lit(tail)))
    bare = F.regexp_replace(raw, "^0+", "")
    return F.when(raw == "", None).when(bare == "", F.lit("0")).otherwise(bare)


def halve_doubled(c: Column) -> Column:
    """Every second character, where all pairs of characters are equal."""
    return F.when(c.rlike(r"^(?:(.)\1)+$"), F.regexp_replace(c, r"(.)\1", "$1")).otherwise(c)


def repair_phone(c: Column) -> Column:
    """Digits, plus, hyphen, space and comma; a plus only in front; separators trimmed at both ends."""
    kept = squeeze(F.regexp_replace(c, r"[^0-9+\-, ]", ""))
    lead = F.when(kept.startswith("+"), F.lit("+")).otherwise(F.lit(""))
    return F.regexp_replace(F.concat(lead, F.replace(kept, F.lit("+"), F.lit(""))), r"^[,\- ]+|[,\- ]+$", "")


def decimal_of(c: Column) -> Column:
    """Thousands separators out, point kept."""
    return F.replace(c, F.lit(","), F.lit("")).try_cast("decimal(18,2)")


def tax_id(c: Column) -> Column:
    return F.regexp_replace(c, f"[^{LETTERS}{DIGITS}_]", "")


def or_default(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def search_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), f"[^{LOWER}{DIGITS}_]+"), lambda t: (t != "") & ~t.isin(STOP_WORDS)))
