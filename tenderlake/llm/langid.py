"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams (1 to 3 characters, BINS bins) by language come from about TRAIN_ROWS different
labelled documents of each language, picked by a hash of doc_id and text; of a language with fewer,
from all. The matrix of log-probabilities has a row for each bin and a column for each language, in
shards of SHARD languages: each is counted, broadcast and scored by itself, so that no task holds more
than one, and a document's best language and probability are carried from shard to shard. Batches of
documents are scored as one sparse product: the matrix's rows of all their n-grams, CELLS numbers at a
time, added up by document. The model as a whole is on the driver: 256 kB a language.

`fit` tells texts that are in none of the languages: by how much, in logarithms an n-gram, blanks left
out, the language explains the text better than a choice of bins at random; below 0 it doesn't.

A text that is null or has no letter is `und` with score and fit 0. Rows without a language aren't
learned from. With no labelled row, every text is `und`. Rows that repeat are scored alike; other
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._ngrams import chunks, codes, dense_counts
from ._worker import keep, parts

ORDERS = (1, 2, 3)
BINS = 1 << 16
TRAIN_ROWS = 10_000
CELLS = 1 << 22
SHARD = 128
UNKNOWN = "und"


@dataclass
class Shard:
    """Some of a model's languages."""

    languages: list[str]
    weights: np.ndarray  # (bins + 1, languages): log-probabilities; the last row, of no n-gram, is 0
    prior: np.ndarray

    @property
    def bins(self) -> int:
        return len(self.weights) - 1


@dataclass
class Model:
    shards: list[Shard]

    @property
    def languages(self) -> list[str]:
        return [x for s in self.shards for x in s.languages]


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def _counter(bins: int):
    def count(batch: pa.RecordBatch, totals: dict[str, np.ndarray]) -> None:
        texts, langs = (c.to_pylist() for c in batch.columns)
        for lang in set(langs):
            for _, points, edges in chunks([t for t, x in zip(texts, langs) if x == lang]):
                for order in ORDERS:
                    totals[lang] += np.bincount(codes(points, edges, order, bins), minlength=bins + 1)[:bins]

    return count


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS, shard: int = SHARD, bins: int = BINS) -> Model:
    """labelled (doc_id, text, lang): about train_rows different documents of each language are read; copies of one that is read are read too."""
    spark = labelled.sparkSession
    name = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 52))
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", name.alias("name"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("name").alias("different"))
    there = {r["lang"]: r for r in sizes.collect()}  # a row a language
    languages, total, made = sorted(there), sum(r["n"] for r in there.values()), []
    for k in range(0, len(languages), shard):
        own = languages[k : k + shard]
        shares = spark.createDataFrame([(x, min(1.0, train_rows / there[x]["different"])) for x in own], "lang string, share double")
        drawn = known.join(F.broadcast(shares), "lang").where(F.col("name") < F.col("share") * float(1 << 52))  # `shard` rows at most
        counts = dense_counts(drawn.select("text", "lang"), own, _counter(bins), bins)
        weights = np.zeros((bins + 1, len(own)), np.float32)
        for j, x in enumerate(own):
            weights[:bins, j] = np.log((counts[x] + 0.5) / (counts[x].sum() + 0.5 * bins))
        made.append(Shard(own, weights, np.log([there[x]["n"] / total for x in own])))
    return Model(made)


def _totals(shard: Shard, code: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(documents, languages): the weights of their n-grams added up, CELLS of them at a time."""
    out = np.zeros((len(edges) - 1, len(shard.languages)))
    step = max(1, CELLS // len(shard.languages))
    for low in range(0, len(code), step):
        high = min(low + step, len(code))
        first, last = np.searchsorted(edges, low, "right") - 1, np.searchsorted(edges, high, "left")
        out[first:last] += np.add.reduceat(shard.weights[code[low:high]], np.maximum(edges[first:last], low) - low, axis=0, dtype=np.float64)
    return out


def score(shard: Shard, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the shard's best language, its log-likelihood with its prior, the logarithm of the sum over all the shard's, and the best one's fit; none and -inf for texts without a letter."""
    names, fit = np.array([None] * len(texts), object), np.zeros(len(texts))
    most, every = np.full((2, len(texts)), -np.inf)
    # documents of a slice times languages are numbers, too
    width = max(1, CELLS // len(shard.languages))
    for base in range(0, len(texts), width):
        for first, points, edges in chunks(texts[base : base + width]):
            total, grams = np.tile(shard.prior, (len(edges) - 1, 1)), np.zeros(len(edges) - 1)
            for order in ORDERS:
                code = codes(points, edges, order, shard.bins)
                total += _totals(shard, code, edges)
                grams += np.add.reduceat(code < shard.bins, edges[:-1], dtype=np.float64)
            k = total.argmax(1)
            at = slice(base + first, base + first + len(k))
            names[at] = np.array(shard.languages, object)[k]
            most[at] = total[np.arange(len(k)), k]
            every[at] = most[at] + np.log(np.exp(total - most[at][:, None]).sum(1))
            # blanks stand in every language
            blanks = np.add.reduceat(points == 32, edges[:-1], dtype=np.float64)
            blank = shard.weights[codes(np.array([32], np.uint32), np.array([0, 1]), 1, shard.bins)[0], k]
            fit[at] = (most[at] - shard.prior[k] - blanks * blank) / np.maximum(1, grams - blanks) + np.log(shard.bins)
    for i, text in enumerate(texts):
        if not text or not any(map(str.isalpha, text)):
            names[i], fit[i], most[i], every[i] = None, 0.0, -np.inf, -np.inf
    return names, most, every, fit


_CARRIED = {"lang": pa.string(), "most": pa.float64(), "every": pa.float64(), "fit": pa.float64()}


def _scorer(sent, text_at: int, given: int):
    """Rows of `given` columns and what earlier shards found -> the same with this shard."""
    number = sent._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = keep(("languages", number), lambda: sent.value)
        for batch in parts(batches):
            names, most, every, fit = score(shard, batch.column(text_at).to_pylist())
            lang0, most0, every0, fit0 = (c.to_numpy(zero_copy_only=False) for c in batch.columns[given:])
            better = most > most0
            carried = [np.where(better, names, lang0), np.where(better, most, most0), np.logaddexp(every, every0), np.where(better, fit, fit0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:given], *[pa.array(x, kind) for x, kind in zip(carried, _CARRIED.values())]], batch.schema.names)

    return run


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs with a column text -> the columns `keep`, lang_pred, score, fit."""
    shape = ", ".join([*(f"_c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)), *["_text string"] * ("text" not in keep), "lang string, most double, every double, fit double"])
    beside = [] if "text" in keep else [F.col("text").alias("_text")]
    none = [F.lit(None).cast("string").alias("lang"), *[F.lit(x).alias(c) for c, x in (("most", float("-inf")), ("every", float("-inf")), ("fit", 0.0))]]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(keep)], *beside, *none)
    text_at = keep.index("text") if "text" in keep else len(keep)
    for shard in model.shards:
        sent = docs.sparkSession.sparkContext.broadcast(shard)  # SHARD languages at most
        rows = rows.mapInArrow(_scorer(sent, text_at, len(keep) + len(beside)), shape)
    likely = F.when(F.col("lang").isNull(), F.lit(0.0)).otherwise(F.exp(F.col("most") - F.col("every")))
    return rows.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(keep)], F.coalesce("lang", F.lit(UNKNOWN)).alias("lang_pred"), likely.alias("score"), "fit")
