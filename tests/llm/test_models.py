"""Classifiers: held-out accuracy, folds and awkward input."""

import math
import random
import string
import subprocess
import sys
import time
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlake.llm import langid, queries, secrets, toxicity
from tenderlake.llm._ngrams import chunks, codes

SF = "/root/testdata/sf0.01"


def test_language(spark, docs, rows, none):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    found = queries.op6_langid(spark, SF).collect()
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)
    model = langid.train(docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 3).cast("string"))))
    told = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for d, t in rows:
        assert (told[d]["lang_pred"] == "und") == (not any(map(str.isalpha, t or "")))
    assert langid.identify(none, model).count() == 0
    empty = langid.train(none.withColumn("lang", F.lit("x")))
    assert {r["lang_pred"] for r in langid.identify(docs, empty).collect()} == {"und"}


def test_language_samples(spark):
    """Nameless and repeated rows, languages in several shards, and texts in none of them."""
    letters = ["abc", "def", "ghi", "jkl", "mno", "pqr", "stu", "vwx"]
    say = lambda k, seed: "".join(random.Random(seed).choices(letters[k] + " ", k=200))
    made = [(None, say(k, seed), f"l{k}") for k in range(8) for seed in range(30)] + [(7, say(0, 0), "l0")] * 300
    labelled = spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(3)
    asked = spark.createDataFrame([(k, say(k, 99)) for k in range(8)] + [(8, "これは日本語の文章です")], "doc_id long, text string")
    for rows, shard in ((10_000, langid.SHARD), (20, langid.SHARD), (10_000, 3)):
        model = langid.train(labelled, rows, shard)
        assert len(model.languages) == 8 and len(model.shards) == -(-8 // shard)
        told = {r["doc_id"]: r for r in langid.identify(asked, model).collect()}
        assert all(told[k]["lang_pred"] == f"l{k}" and told[k]["fit"] > 0 for k in range(8))
        assert told[8]["fit"] < 0


def test_language_scores_by_hand(spark, docs, rows):
    """The posterior of plain multinomial naive Bayes, with the languages in one shard and in several."""
    langs = {d: "xyz"[d % 3] if d % 5 else None for d, _ in rows}
    labelled = docs.drop("lang").withColumn("lang", F.when(F.col("doc_id") % 5 > 0, F.element_at(F.array(*map(F.lit, "xyz")), (F.col("doc_id") % 3 + 1).cast("int"))))
    grams = lambda t: [int(c) for _, points, edges in langid.chunks([t]) for order in langid.ORDERS for c in langid.codes(points, edges, order, 1 << 10) if c < 1 << 10]
    counts = {x: Counter(g for d, t in rows if langs[d] == x and t is not None for g in grams(t)) for x in "xyz"}
    n = {x: sum(langs[d] == x and t is not None for d, t in rows) for x in "xyz"}
    own = {d: grams(t) for d, t in rows if any(map(str.isalpha, t or ""))}
    for shard in (128, 2, 1):
        model = langid.train(labelled, shard=shard, bins=1 << 10)
        for r in langid.identify(docs, model).collect():
            if r["doc_id"] not in own:
                assert (r["lang_pred"], r["score"], r["fit"]) == ("und", 0.0, 0.0)
                continue
            z = {x: math.log(n[x] / sum(n.values())) + sum(math.log((counts[x][g] + 0.5) / (counts[x].total() + 512)) for g in own[r["doc_id"]]) for x in "xyz"}
            best = max(z.values())
            assert z[r["lang_pred"]] > best - 1e-2 * (1 + abs(best) / 1000)
            assert abs(r["score"] - 1 / sum(math.exp(v - z[r["lang_pred"]]) for v in z.values())) < 1e-2


def test_memory_of_many_languages():
    """A shard of languages scores long texts within a few hundred MB, whatever their number."""
    code = """
import resource, numpy as np
from tenderlake.llm import langid
rng = np.random.default_rng(0)
texts = ["".join(rng.choice(list("abcdefghij "), 40_000)) for _ in range(13)]
n = 300
shards = [langid.Shard([str(k) for k in range(lo, min(lo + langid.SHARD, n))], np.zeros((langid.BINS + 1, min(langid.SHARD, n - lo)), np.float32), np.zeros(min(langid.SHARD, n - lo))) for lo in range(0, n, langid.SHARD)]
for s in shards:
    langid.score(s, texts)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 500


def test_toxicity_scores_by_hand(spark, docs, rows):
    """The logistic function of the weights of a text's distinct n-grams."""
    marks = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.train(docs, marks)
    found = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, model).collect()}
    for d, t in rows:
        bins = {int(c) for _, points, edges in chunks([t]) for order in toxicity.ORDERS for c in codes(points, edges, order, toxicity.BINS) if c < toxicity.BINS}
        z = model.intercept + sum(float(model.weights[c]) for c in bins)
        assert abs(found[d] - 1 / (1 + math.exp(-z))) < 1e-6


def test_toxicity(spark, docs, none):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    english = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").collect()}
    found = queries.op8_toxicity(spark, SF).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    held = [(r["score"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels and r["doc_id"] in english]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum(a > b for a in bad for b in good) >= 0.85 * len(bad) * len(good)  # 40 toxic documents to learn from
    marks = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.train(docs, marks.union(marks).union(marks.select(F.lit(None).cast("long"), F.lit(1))))
    assert toxicity.toxicity(docs, model).count() == docs.count()
    assert toxicity.toxicity(none, model).count() == 0
    # a doc_id that repeats is learned from once
    one, often = toxicity.train(docs, marks), toxicity.train(docs.unionByName(docs).unionByName(docs), marks)
    assert np.allclose(one.weights, often.weights, atol=1e-4)
    alone = toxicity.train(docs, marks.where("toxic = 0"))
    assert {r["predicted"] for r in toxicity.toxicity(docs, alone).collect()} == {0}


def test_secrets(spark, none):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    made = [(i, f'text before token = "{key[i % 7 :]}{i:06d}" and after') for i in range(40)] + [(100 + i, f"call 12345678901234{i:02d} for it, thank you") for i in range(40)]
    awkward = [(1000 + d, t) for d, t in brute.corpus()]
    docs = spark.createDataFrame([*made, *awkward], "doc_id long, text string").repartition(4)
    found = secrets.scan(docs).collect()
    by = {r["doc_id"]: r for r in found if r["doc_id"] < 1000}
    assert len(by) == 80 and all(by[i]["is_secret"] == (i < 100) for i in by)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, secrets.scan(docs)).collect()}
    assert clean[0] == 'text before token = "[secret]" and after' and clean[100] == made[40][1]
    assert secrets.scan(none).count() == 0


def test_redact_any_row(spark):
    """Rows without a doc_id lose their secrets as well, and columns named like helpers stay."""
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    made = [(None if i % 3 == 0 else i, f'text before token = "{key[i % 7 :]}{i:06d}" and after') for i in range(30)] + [(5, f'once more token = "{key}xyz" there'), (None, None), (None, "")]
    docs = spark.createDataFrame(made, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("_found", "found", "id", "row", "finding", "of")})
    out = secrets.redact(docs, secrets.scan(docs))
    assert out.columns == docs.columns and out.where("_found = 'mine' and id = 'mine'").count() == len(made)
    texts = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert texts[None, 'text before token = "[secret]" and after'] == 10
    assert texts[5, 'once more token = "[secret]" there'] == texts[None, None] == texts[None, ""] == 1
    assert not any(key[7:] in (t or "") for _, t in texts)


def test_long_runs(spark):
    """Features of a run are linear in its length."""
    rnd = random.Random(1)
    run = lambda n: "".join(rnd.choices(string.ascii_letters + string.digits, k=n))
    began = time.time()
    docs = spark.createDataFrame([(1, run(200_000)), (2, f'password = "{run(100_000)}"'), (3, run(20))], "doc_id long, text string")
    assert {r["doc_id"] for r in secrets.scan(docs).collect()} == {1, 2, 3}
    assert time.time() - began < 60
    found = spark.createDataFrame([("aabbbc",), ("x",), ("日日本a",)], "finding string").selectExpr("monotonically_increasing_id() as finding_id", "finding", "finding as word", "'' as before", "'' as after")
    entries = spark.createDataFrame([("aabb", 3), ("bbcc", 1)], "entry string, n long")
    got = {r["finding"]: (r["entropy"], r["pairs"]) for r in secrets.features(found, entries).collect()}
    share = {"aa": 3 / 4, "ab": 3 / 4, "bb": 4 / 4, "bc": 1 / 4}
    said = lambda *pairs: sum(math.log(share[p] + 1e-6) if p in share else secrets.UNLIKELY for p in pairs) / max(1, len(pairs))
    want = {"aabbbc": (-(math.log2(1 / 3) / 3 + math.log2(1 / 2) / 2 + math.log2(1 / 6) / 6), said("aa", "ab", "bb", "bb", "bc")), "x": (0.0, said()), "日日本a": (1.5, said("日日", "日本", "本a"))}
    for f in want:
        assert abs(got[f][0] - want[f][0]) < 1e-9 and abs(got[f][1] - want[f][1]) < 1e-9


def test_secrets_of_other_shapes(spark):
    """Without a digit, short, or broken by punctuation; long words stay candidates that the forest turns down."""
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    made = [(i, f'text before token = "{key[i % 7 :]}{i:06d}" and after') for i in range(40)] + [(100 + i, f"call 12345678901234{i:02d} for internationalization, thank you") for i in range(40)]
    secret = {
        500: ('set password = "P@ss.w0rd!2024" there', "P@ss.w0rd!2024"),
        501: ('the token = "qZxWvKjPqRtYbNmLkHgF" is', "qZxWvKjPqRtYbNmLkHgF"),
        502: ('{"user":"x","password":"hunter22","n":1}', "hunter22"),
        503: ("api_key: 'ab12-cd34.ef' end", "ab12-cd34.ef"),
        504: ("password= `k7#mQ2!x` end", "k7#mQ2!x"),
    }
    bare = {600: ("login with pwd: hunter2, then go", "hunter2"), 601: ("PASSWORD=s3cr.et!9", "s3cr.et!9"), 602: ("my secret: T7-x.q5!", "T7-x.q5!"), 603: ('auth_token => "aa11"', None)}
    docs = spark.createDataFrame([*made, *[(d, t) for d, (t, _) in {**secret, **bare}.items()]], "doc_id long, text string").repartition(4)
    found = secrets.scan(docs).collect()
    there = {(r["doc_id"], r["finding"]): r["is_secret"] for r in found}
    assert {v: there.get((d, v)) for d, (_, v) in secret.items()} == {v: True for _, v in secret.values()}
    assert all((d, v) in there for d, (_, v) in bare.items() if v) and not any(d == 603 for d, _ in there)
    assert all(there[100 + i, "internationalization"] is False for i in range(40))
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, secrets.scan(docs)).collect()}
    assert clean[500] == 'set password = "[secret]" there' and clean[502] == '{"user":"x","password":"[secret]","n":1}'


def _planted(seed: int, n: int) -> tuple[list[tuple[int, str]], set[tuple[int, str]], set[int]]:
    """Documents with secrets of several kinds, announced in several ways, and with look-alikes that are none."""
    rnd = random.Random(seed)
    draw = lambda letters, k: "".join(rnd.choice(letters) for _ in range(k))
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    kinds = [lambda: draw(hexes, 40), lambda: "AKIA" + draw(string.ascii_uppercase + string.digits, 16), lambda: draw(alnum, 32), lambda: "ghp_" + draw(alnum, 36), lambda: draw(alnum + "+/", 43) + "="]
    ways = ['the token = "{}" is set', "password='{}' there", '{{"secret": "{}"}}', "api_key: {} was used", "export SECRET={} then", "it said {} at the end"]
    fakes = [lambda: draw("123456789", 18), lambda: "/".join(rnd.choice(["usr", "local", "share", "reports", "archive"]) for _ in range(5)), lambda: "internationalization" + rnd.choice(["s", "ist", "ing", ""]), lambda: "-".join(rnd.choice(["well", "known", "state", "of", "the", "art", "long"]) for _ in range(5)), lambda: "_" * rnd.randint(16, 40)]
    prose = ["the state of the art is well known", "usr local share reports archive", "internationalization of long reports", "call the archive then"]
    docs, secrets_, clean = [], set(), set()
    for i in range(n):
        if i % 2:
            value = rnd.choice(kinds)()
            docs.append((i, f"{rnd.choice(prose)} {rnd.choice(ways).format(value)} {rnd.choice(prose)}"))
            secrets_.add((i, value))
        else:
            docs.append((i, f"{rnd.choice(prose)} see {rnd.choice(fakes)()} and {rnd.choice(prose)}"))
            clean.add(i)
    return docs, secrets_, clean


def test_secret_recall_and_precision(spark):
    """Secrets that no quotes or name announce are found as well; what the weak labels hold for secrets and look-alikes is judged by its looks."""
    docs, planted, clean = _planted(5, 600)
    found = secrets.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).where("is_secret").select("doc_id", "finding").collect()
    told = {(r["doc_id"], r["finding"]) for r in found}
    assert len(told & planted) >= 0.9 * len(planted)
    assert len(told & planted) >= 0.9 * len(told)
    assert sum(d in clean for d, _ in told) <= 0.05 * len(clean)


def test_secrets_from_given_labels(spark):
    docs, planted, clean = _planted(6, 200)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    candidates = secrets.find(df).select("doc_id", "finding").collect()
    labels = spark.createDataFrame([(r["finding"], float((r["doc_id"], r["finding"]) in planted)) for r in candidates if r["doc_id"] < 100], "finding string, label double")
    held = [r for r in secrets.scan(df, labels=labels).collect() if r["doc_id"] >= 100]
    assert sum(r["is_secret"] == ((r["doc_id"], r["finding"]) in planted) for r in held) >= 0.9 * len(held)


def test_secret_sample_has_both_labels(spark):
    made = [(float(y), *[float(y * i + k) for k in range(len(secrets.FEATURES))]) for y, n in ((1, 300), (0, 1)) for i in range(n)]
    rows = [(i, str(i % 301), "", *r) for i, r in enumerate(made * 2)]
    labelled = spark.createDataFrame(rows, ["finding_id", "finding", "before", "label", *secrets.FEATURES])
    assert secrets.train(labelled, findings=6) is not None
    count = lambda n: {r["label"]: r["count"] for r in secrets.sample(labelled, n).groupBy("label").count().collect()}
    assert count(6) == {0.0: 1, 1.0: 5} and count(1000) == {0.0: 1, 1.0: 300}
    assert secrets.train(labelled.where("label = 1"), findings=6) is None


@pytest.mark.parametrize("name", ["op2_secrets"])
def test_planted_tokens(spark, name):
    found = queries.QUERIES[name](spark, SF)
    there = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit('token = "([0-9a-f]{40})"'), 1)).alias("f"))
    assert found.where("is_secret").select("doc_id", F.lower("finding").alias("f")).exceptAll(there).count() == 0
    assert there.exceptAll(found.where("is_secret").select("doc_id", F.lower("finding").alias("f"))).count() == 0
