"""Lines of documents, and the blocks they make; all inside a document's row, with no shuffle.

Arrays are exploded in the outer form and rows without a place dropped after it: Spark would put a
test of the array's size before the plain form, and make the array twice.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze

#: Stands between blocks while a text is cut; in texts it counts as a blank.
BREAK = "\x1e"


def continued(text: Column, keep=None) -> Column:
    """Lines with a colon, squeezed, each with the lines without one that follow it; those before the first colon, and blank lines, go. keep: a test of lines, as they stand."""
    colon = lambda x: F.contains(x, F.lit(":"))
    own = colon if keep is None else lambda x: colon(x) & keep(x)
    # lines are looked at one by one: patterns that look ahead from each line's end cost several times as much
    joined = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.when(colon(x), F.lit("\n")).otherwise(F.lit(" ")), x)), "")
    # most texts have no white space that squeezing changes: looked for once a text, byte by byte
    uneven = lambda j: reduce(or_, [F.contains(j, F.lit(x)) for x in ("  ", "\t", "\x0b", "\x0c", "\r")])
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    return let(joined, lambda j: let(F.filter(F.split(j, "\n"), own), lambda kept: F.when(uneven(j), F.transform(kept, squeeze)).otherwise(F.transform(kept, lambda x: F.trim(x)))))


def blocks(text: Column, marker: str) -> Column:
    """What follows each marker line, that line included, up to the next; a marker line has the marker and a colon."""
    starts = lambda x: F.contains(x, F.lit(marker)) & F.contains(x, F.lit(":"))
    marked = F.transform(F.split(F.replace(text, F.lit(BREAK), F.lit(" ")), "\n"), lambda x: F.when(starts(x), F.concat(F.lit(BREAK), x)).otherwise(x))
    parts = F.split(F.array_join(marked, "\n"), BREAK)
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line): lines that aren't blank."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")


def join_continuations(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, pos, line): each line of `continued`."""
    return docs.select("doc_id", F.posexplode_outer(continued(F.col("text"))).alias("pos", "line")).where("pos is not null")


def segment_blocks(docs: DataFrame, marker: str = "Product Name") -> DataFrame:
    """docs (doc_id, text) -> (doc_id, block, pos, line): the lines of each block that aren't blank; blocks count from 1."""
    each = docs.select("doc_id", F.posexplode_outer(blocks(F.col("text"), marker)).alias("block", "part")).where("block is not null")
    return each.select("doc_id", (F.col("block") + 1).cast("long").alias("block"), F.posexplode(F.split("part", "\n")).alias("pos", "line")).where(F.trim("line") != "")
