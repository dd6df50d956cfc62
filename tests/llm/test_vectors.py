"""Hard negatives against SQL and plain Python; nearest neighbours against brute force."""

import random

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from tenderlake.llm import ann, hard_negatives, queries

INF, NAN = float("inf"), float("nan")


def test_strassen_is_the_product():
    rng = np.random.default_rng(1)
    for m, k, n, leaf in [(1, 1, 1, 1), (7, 5, 3, 1), (33, 64, 70, 8), (100, 65, 130, 16), (256, 64, 300, 32)]:
        a, b = rng.integers(-(2**30), 2**30, (m, k)), rng.integers(-(2**30), 2**30, (k, n))
        assert (hard_negatives.strassen(a, b, leaf) == a @ b).all()
    assert hard_negatives.strassen(np.zeros((0, 4), np.int64), np.zeros((4, 3), np.int64)).shape == (0, 3)


def test_hard_negatives_by_sql(spark, sf):
    same(queries.op11_hard_negatives(spark, sf), queries.OP11_SQL, sf)


@pytest.fixture(scope="module")
def vectors():
    """Few different vectors, so that scores tie; copies; and rows that take no part."""
    rnd = random.Random(3)
    pool = [[rnd.choice([-0.5, -0.1, 0.0, 0.3, 0.75]) for _ in range(5)] for _ in range(30)]
    rows = [(i, rnd.choice(pool), rnd.randrange(3)) for i in range(160)]
    rows += [(i, pool[0], 1) for i in range(160, 260)]
    odd = [(None, pool[1], 1), (300, None, 1), (301, pool[1], None), (302, [0.1, None, 0.1, 0.1, 0.1], 1), (303, [0.1, NAN, 0.1, 0.1, 0.1], 1), (304, [0.1, INF, 0.1, 0.1, 0.1], 1), (305, [], 1), (306, [1.0, 1.0], 1), (307, [0.0] * 5, 1)]
    return rows, odd


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return df.withColumns({c: F.lit("mine") for c in ("id", "vector", "_anchor", "asks", "shard", "scores")}).repartition(7)


def _mined(rows, positives=5, negatives=5):
    known = [(i, [int(np.floor(256.0 * x)) for x in v], y) for i, v, y in rows]
    for a, v, y in known:
        if a % 10:
            continue
        scores = [(sum(p * q for p, q in zip(v, w)), i, z) for i, w, z in known if i != a]
        for s, p, _ in sorted([x for x in scores if x[2] == y], key=lambda x: (-x[0], x[1]))[:positives]:
            near = sorted([x for x in scores if x[2] != y and 80 * s <= 100 * x[0] <= 100 * s], key=lambda x: (-x[0], x[1]))[:negatives]
            yield from ((a, p, k, n, s, t) for k, (t, n, _) in enumerate(near, 1))


def test_hard_negatives_by_hand(spark, vectors):
    rows, odd = vectors
    zero = [(307, [0.0] * 5, 1)]  # a vector like others here
    want = sorted(_mined(rows + zero))
    # the same rows again change nothing; small shards and parts of the anchors neither
    for given, bytes_, served in [(rows + odd, 1 << 26, 1 << 16), (rows + odd + rows[:40], 300, 7)]:
        out = hard_negatives.mine(_frame(spark, given), F.col("vec_id") % 10 == 0, shard_bytes=bytes_, served=served)
        assert sorted(map(tuple, out.collect())) == want
    assert want and hard_negatives.mine(_frame(spark, odd[:4]), F.lit(True)).count() == 0
    assert hard_negatives.mine(_frame(spark, rows).limit(0), F.lit(True)).count() == 0


def test_ids_of_several_rows(spark):
    """None of them is a positive or negative of its own id, whichever shard it is in."""
    rows = [(0, [1.0, 0.0], 1), (0, [0.9, 0.0], 1), (0, [0.9, 0.0], 2), (1, [0.8, 0.0], 1), (2, [0.7, 0.0], 2), (2, [0.75, 0.0], 2)]
    out = hard_negatives.mine(_frame(spark, rows), F.col("vec_id") == 0)
    # the anchor is (0.9, 0): the least of its label
    assert sorted(map(tuple, out.collect())) == [(0, 1, 1, 2, 204 * 230, 192 * 230), (0, 1, 2, 2, 204 * 230, 179 * 230)]


def _near(rows, asks, k=20):
    for q, v, _ in rows:
        if q % asks == 0:
            scores = sorted(((-float(np.dot(v, w)), i) for i, w, _ in rows if i != q))[:k]
            yield q, [(i, -s) for s, i in scores]


def test_nearest_of_few(spark, vectors):
    """A radius that finds too few is widened, ties go by id, and copies of a query are found."""
    rows, odd = vectors
    rows, odd = [x for x in rows if any(x[1])], [x for x in odd if x[2]]
    for given, bytes_, served in [(rows + odd, 1 << 26, 1 << 16), (rows + odd + rows[:40], 200, 5)]:
        out = ann.nearest(_frame(spark, given), F.col("vec_id") % 20 == 0, k=20, shard_bytes=bytes_, served=served).collect()
        got = {}
        for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
            assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        want = dict(_near(rows, 20))
        assert got.keys() == want.keys()
        by_id = {i: v for i, v, _ in rows}
        hits = 0
        for q, found in got.items():
            assert len(found) == 20 and found == sorted(found, key=lambda x: (-x[1], x[0])) and q not in dict(found)
            assert all(abs(s - float(np.dot(by_id[q], by_id[i]))) < 1e-12 for i, s in found)
            hits += len({s for _, s in found} & {s for _, s in want[q]}) / max(1, len({s for _, s in want[q]}))
        assert hits / len(got) > 0.9
    assert ann.nearest(_frame(spark, odd), F.lit(True)).count() == 0
    few = ann.nearest(_frame(spark, [(0, [1.0, 2.0], 1), (1, [2.0, 1.0], 1), (1, [3.0, 1.0], 1)]), F.lit(True), k=3)
    assert sorted(map(tuple, few.collect())) == [(0, 1, 1, 5.0), (1, 1, 0, 4.0)]


def test_recall(spark, sf):
    found = queries.op13_nearest(spark, sf).collect()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = [(r["vec_id"], np.array(r["embedding"], float), 0) for r in table]
    want = {q: {i for i, _ in x} for q, x in _near(rows, 20)}
    assert len(found) == 20 * len(want)
    assert sum(r["vec_id"] in want[r["query_id"]] for r in found) >= 0.95 * len(found)


@pytest.mark.parametrize("kind", ["clusters", "lengths", "shifted"])
def test_recall_of_other_shapes(kind):
    """Groups of near vectors, vectors of very different lengths, and vectors far from the origin."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6_000, 24))
    if kind == "clusters":
        x = x[rng.integers(0, 60, 6_000)] + 0.2 * x
    elif kind == "lengths":
        x *= rng.lognormal(0, 0.7, (6_000, 1))
    else:
        x += 3.0
    ids = np.arange(6_000)
    model = ann.learn(x[:3_000], float(np.linalg.norm(x, axis=1).max()), 20)
    index, hits = ann.Index(model, ids, x), 0
    for q in range(0, 6_000, 60):
        got, scores = index.nearest(q, x[q], model.code_queries(x[q : q + 1])[0], 20)
        exact = x @ x[q]
        exact[q] = -np.inf
        hits += len(set(got.tolist()) & set(np.argsort(-exact, kind="stable")[:20].tolist()))
    assert hits >= 0.9 * 20 * 100


def test_all_codes_within_a_radius():
    """The directories give what a comparison of all codes gives, at every radius."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 16))
    x[500:] = x[:400] + 0.05 * rng.standard_normal((400, 16))
    model = ann.learn(x, float(np.linalg.norm(x, axis=1).max()), 5, bits=64)
    index = ann.Index(model, np.arange(900), x)
    for q in (0, 17, 600):
        code = model.code_queries(x[q : q + 1])[0]
        far = ann.distances(index.codes, code)
        for radius in range(65):
            assert index.within(code, radius).tolist() == np.flatnonzero(far <= radius).tolist()
