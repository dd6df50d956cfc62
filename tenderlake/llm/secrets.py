"""Secret scan: candidates by their shape or name, false positives removed by a random forest.

A candidate is a run of 16 or more of [A-Za-z0-9+/_-] inside a word, with up to two = behind it, or a value of 6 or more characters
that = or : assigns to a name like token or password: up to its closing quote, or else to the end of the
word without closing punctuation. Of a quoted value with blanks the first word counts.

Features: length, shares of character classes, entropy, transitions (switches of class, and the
likelihood of its letter pairs in the corpus's dictionary), dictionary coverage, path marks, and
whether the words before and after are prose. The dictionary is the DICTIONARY most frequent words of
four letters or more over all documents, of those found more than once.

The forest is Spark's, fitted on at most FINDINGS labelled findings that differ in label or features:
of each label half of them, or more where the other has fewer, the first by hash. `scan` takes a table
of labelled findings (finding, label); the given tables bring none, so `weak_labels` labels by what
stands around a finding and nothing in it: a quoted value assigned to a name like token or password
is a secret; one with no such name and no assignment near is none; others have no label. The forest
sees none of the signs that labels come from, so it can't learn the rule back: it learns what secrets
look like, and judges labelled findings too. A quoted value under such a name that looks like prose
is turned down, a bare key that no name announces is found. With labels of one class only, no forest
can be fitted and each finding keeps its label, unlabelled ones counting as secrets.

Only DataFrame functions and Spark ML run here, no Python on the executors. A null or empty text has
no finding. Findings in rows that repeat are reported for each row. Columns of docs other than
doc_id and text aren't read.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import staged

BLANKS = r"[\x20\x09-\x0D]+"
RUN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
DICTIONARY = 5_000
FINDINGS = 20_000
#: The logarithm of a letter pair's share that the dictionary hasn't.
UNLIKELY = -13.8
NAMES = "token|secret|password|passwd|pwd|api|key|auth|bearer|credential|private"
#: A name, what closes it, and what assigns to it.
NAME = rf"(?i)(?:{NAMES})\w*[\\\"'`\])]*"
ASSIGNS = rf"{NAME}\s*[=:]+>?\s*"
QUOTED = rf"{ASSIGNS}\\?([\"'`])(\S{{6,}}?)(?:\\?\1|$)"
BARE = rf"{ASSIGNS}([^\s\"'`\\]\S{{4,}}[^\s.,;:)\]}}>\"'`\\])"

FEATURES = ["n", "digits", "lowers", "uppers", "hex", "entropy", "switches", "pairs", "dictionary", "slashes", "dashes", "path", "prose_before", "prose_after"]


def find(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> finding_id, doc_id, word_no (from 0), word, finding, told (a quoted value assigned to a name), before, after; written in the shared folder."""
    told = F.col("text").rlike(rf"{ASSIGNS}\S{{6}}")
    worded = docs.where(F.col("text").rlike(RUN) | told).select("doc_id", F.split("text", BLANKS).alias("words"), told.alias("told"))
    around = lambda i, d: F.coalesce(F.get("words", i + d), F.lit(""))
    near = lambda i: F.concat_ws(" ", around(i, -2), around(i, -1), around(i, 0)).rlike(rf"{ASSIGNS}\S{{6}}")
    hits = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).rlike(RUN) | (F.col("told") & near(i)))
    shape = F.transform(
        hits,
        lambda i: F.struct(i.alias("word_no"), F.get("words", i).alias("word"), F.concat_ws(" ", around(i, -3), around(i, -2), around(i, -1)).alias("before"), around(i, 1).alias("after")),
    )
    rows = worded.select("doc_id", F.explode(shape).alias("hit")).select("doc_id", "hit.*")
    # the word after a name that ends before it, if one does: values are those that begin in the word
    named = F.concat(F.regexp_extract("before", rf"{NAME}(?:\s*[=:]+>?)?$", 0), F.lit(" "), "word")
    parts = rows.withColumns({"runs": F.regexp_extract_all("word", F.lit(f"({RUN})"), 1), "quoted": F.regexp_extract_all(named, F.lit(QUOTED), 2), "bare": F.regexp_extract_all(named, F.lit(BARE), 1)})
    values = F.filter(F.concat("quoted", "bare"), lambda v: ~F.array_contains("runs", v))
    found = parts.withColumn("finding", F.explode(F.concat("runs", values))).withColumn("told", F.array_contains("quoted", F.col("finding")))
    return staged(found.select(F.monotonically_increasing_id().alias("finding_id"), "doc_id", "word_no", "word", "finding", "told", "before", "after"), "findings")


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """(entry, n): the most frequent words of ASCII letters, lower case, four or more, over all documents; a word found once could be the secret."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("entry")).where(F.length("entry") >= 4)
    return staged(words.groupBy("entry").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "entry").limit(size), "dictionary")


def _share(pattern: str) -> Column:
    return F.regexp_count("finding", F.lit(pattern)) / F.length("finding")


def features(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """Findings with the columns FEATURES."""
    total = float(entries.agg(F.sum("n")).first()[0] or 1)
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("entry") - 1), lambda i: F.substring(F.col("entry"), i, F.lit(2))))
    # at most 676 rows
    shares = dict(entries.select(pair.alias("pair"), "n").groupBy("pair").agg(F.log(F.sum("n") / total + 1e-6)).collect())
    letters = "abcdefghijklmnopqrstuvwxyz"
    table = F.array(*[F.lit(float(shares.get(x + y, UNLIKELY))) for x in letters for y in letters])
    place = F.transform(F.split(F.lower("finding"), ""), lambda c: F.when(c.between("a", "z"), F.ascii(c) - 97))
    # a pair with another character has no place, and get() of none is null
    firsts, seconds = F.slice(place, 1, F.length("finding") - 1), F.slice(place, 2, F.length("finding") - 1)
    likeness = F.zip_with(firsts, seconds, lambda x, y: F.coalesce(F.get(table, x * 26 + y), F.lit(UNLIKELY)))
    likely = F.aggregate(likeness, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.length("finding") - 1, F.lit(1))
    runs = findings.select("finding_id", F.explode(F.regexp_extract_all(F.lower("finding"), F.lit("([a-z]{4,})"), 1)).alias("entry"))
    # DICTIONARY rows at most
    covered = runs.join(F.broadcast(entries), "entry").groupBy("finding_id").agg(F.sum(F.length("entry")).alias("covered"))
    # equal characters stand together once sorted: a run of k adds k log k
    turn = lambda x, k, e: F.struct(x.alias("x"), k.cast("int").alias("k"), e.alias("e"))
    closed = lambda a: a["e"] + a["k"] * F.log2(F.greatest(a["k"], F.lit(1)))
    spread = F.aggregate(F.array_sort(F.split("finding", "")), turn(F.lit(""), F.lit(0), F.lit(0.0)), lambda a, x: F.when(x == a["x"], turn(a["x"], a["k"] + 1, a["e"])).otherwise(turn(x, F.lit(1), closed(a))), closed)
    entropy = F.log2(F.length("finding")) - spread / F.length("finding")
    prose = lambda c: F.col(c).rlike(r"^\p{L}+[,.;:]?$").cast("double")
    local = {
        "n": F.length("finding").cast("double"),
        "digits": _share("[0-9]"),
        "lowers": _share("[a-z]"),
        "uppers": _share("[A-Z]"),
        "hex": _share("[0-9a-fA-F]"),
        "entropy": entropy,
        "pairs": likely,
        "switches": _share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])"),
        "slashes": _share("/"),
        "dashes": _share("[-_]"),
        "path": F.col("word").rlike(r"://|^\.{0,2}/|\.[a-z]{2,4}\b").cast("double"),
        "prose_before": F.element_at(F.split("before", " "), -1).rlike(r"^\p{L}+[,.;:]?$").cast("double"),
        "prose_after": prose("after"),
    }
    joined = findings.join(covered, "finding_id", "left")
    return joined.withColumns(local).withColumn("dictionary", F.coalesce(F.col("covered"), F.lit(0)) / F.col("n")).drop("covered")


def weak_labels(rows: DataFrame) -> DataFrame:
    """Findings with `label`, by what stands around them: 1.0, 0.0, or null where that tells nothing."""
    around = F.concat_ws(" ", "before", "word")
    near = around.rlike(f"(?i)(?:{NAMES})") | around.rlike("=|:(?!//)")
    return rows.withColumn("label", F.when(F.col("told"), F.lit(1.0)).when(~near, F.lit(0.0)))


def given_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Findings with the label of labels (finding, label); the largest where they differ."""
    known = labels.where(F.col("label").isNotNull()).groupBy("finding").agg(F.max(F.col("label").cast("double")).alias("label"))
    return rows.join(known, "finding", "left")


def sample(labelled: DataFrame, findings: int = FINDINGS) -> DataFrame | None:
    """(label, FEATURES), each once: findings of them at most, of both labels; None if all are of one."""
    known = labelled.where(F.col("label").isNotNull()).select("label", *FEATURES).distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    room = {0.0: max(findings // 2, findings - counts[1.0]), 1.0: max(findings // 2, findings - counts[0.0])}
    no, yes = (known.where(F.col("label") == y).orderBy(F.xxhash64(*FEATURES), *FEATURES).limit(n) for y, n in room.items())
    return no.union(yes)


def train(labelled: DataFrame, trees: int = 20, depth: int = 6, findings: int = FINDINGS) -> PipelineModel | None:
    """A forest on labelled findings (label, FEATURES); None if they are of one class."""
    known = sample(labelled, findings)
    if known is None:
        return None
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featuresCol="features", labelCol="label")
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    return PipelineModel([assembler, forest.fit(assembler.transform(known))])


def scan(docs: DataFrame, threshold: float = 0.5, labels: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, word_no, finding, probability, is_secret: every candidate and the forest's verdict. labels: (finding, label), 1 for secrets; weak labels without."""
    found = features(find(docs), dictionary(docs))
    rows = staged(weak_labels(found) if labels is None else given_labels(found, labels), "finding-features")
    forest = train(rows)
    if forest is None:
        judged = rows.withColumn("probability", F.coalesce("label", F.lit(1.0)))
    else:
        judged = forest.transform(rows).withColumn("probability", F.element_at(vector_to_array("probability"), 2))
    return judged.select("doc_id", "word_no", "finding", "probability", (F.col("probability") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, secrets: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with each confirmed secret of its document replaced in text, longer ones first.

    secrets: as scan() gives them. Each row is searched again, and loses those of its findings that its
    doc_id, null like any other, has a confirmed secret of; so what is gathered for a row is its own.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = staged(docs.select(F.monotonically_increasing_id().alias("id"), whole.alias("row")), "texts-to-redact")
    own = find(rows.select(F.struct("id", F.col("row.doc_id").alias("name")).alias("doc_id"), F.col("row.text").alias("text")))
    sure = secrets.where("is_secret").select(F.col("doc_id").alias("of"), F.col("finding").alias("secret")).distinct()
    hits = own.select("doc_id.id", "doc_id.name", "finding").join(sure, F.col("name").eqNullSafe(F.col("of")) & (F.col("finding") == F.col("secret")), "left_semi")
    longer = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    found = hits.groupBy("id").agg(F.array_sort(F.collect_set("finding"), longer).alias("found"))
    cleaned = F.aggregate(F.coalesce("found", F.array().cast("array<string>")), F.col("row.text"), lambda text, s: F.replace(text, s, F.lit(mask)))
    return rows.join(found, "id", "left").select(*[(cleaned if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
