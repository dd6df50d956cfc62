"""The stream's state against the batch fold, restarts, and replays."""

import json

from oracle import rows_of
from pyspark.sql import functions as F

from tenderlake import fixtures as fx
from tenderlake.operators.folds import upsert, upsert_batch
from tenderlake.sources.pages import explode_pages, flatten_bids
from tenderlake.sources import commits
from tenderlake.streaming import ingest, rates
from tenderlake.streaming.ingest import KEEP, LAST_WINS, compact_pages, fold_batch, rate_by_window, read_pages, read_state, stream_upsert


def test_stream_equals_batch_and_restarts(spark, sf, tmp_path):
    pages = fx.pages_json(spark, sf).orderBy("page_num").collect()
    landed, state, marks = (tmp_path / x for x in ("in", "state", "checkpoint"))
    landed.mkdir()

    def land(part):
        for r in part:
            (landed / f"page_{r['page_num']}.json").write_text(json.dumps({"page_num": r["page_num"], "body": r["body"]}) + "\n")

    def run():
        q = stream_upsert(spark, str(landed), str(state), str(marks), max_files=40)
        q.awaitTermination()

    land(pages[:60])
    run()
    versions = len(list(state.iterdir()))
    run()  # nothing new: no batch
    assert len(list(state.iterdir())) == versions
    land(pages[60:])
    run()
    (landed / "broken").write_text("{no json\n" + json.dumps({"page_num": 7000, "body": "{}"}) + "\n")
    run()
    # files come in the order of their landing, so the first batches' rows come first
    order = {r["page_num"]: k for k, r in enumerate(pages)}
    seen = flatten_bids(explode_pages(fx.pages_json(spark, sf))).where("b_id is not null")
    got = {r["b_id"]: r for r in read_state(spark, str(state)).collect()}
    last = {}
    for r in sorted(seen.collect(), key=lambda r: (order[r["page_num"]] >= 60, order[r["page_num"]], r["pos"])):
        last[r["b_id"]] = r
    assert set(got) == set(last)
    told = [b for b in got if (got[b]["b_status"], got[b]["final_end_date_sort"]) == (last[b]["b_status"], last[b]["final_end_date_sort"])]
    assert len(told) >= 0.5 * len(last)  # batches hold 40 files in the order of their time stamps, which may tie
    read = read_pages(spark, str(state))
    assert read.where("page_num < 7000").count() == len(pages)
    assert sorted(r["value"][:3] for r in read.where("not ok and coalesce(page_num, 7000) = 7000").collect()) == ['{"p', "{no"]
    assert len(commits.versions(spark, str(state))) <= KEEP


def test_one_batch_equals_the_fold(spark, sf, tmp_path):
    pages = fx.pages_json(spark, sf)
    pages.select(F.to_json(F.struct("page_num", "body")).alias("value")).write.text(str(tmp_path / "in"))
    stream_upsert(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "marks"), buckets=5).awaitTermination()
    flat = flatten_bids(explode_pages(pages)).where("b_id is not null").withColumn("seq", F.struct("page_num", "pos")).drop("page_num", "pos")
    batch = upsert(flat, "b_id", "seq", LAST_WINS)
    got = read_state(spark, str(tmp_path / "state"))
    assert rows_of(got.select(batch.columns).toPandas()) == rows_of(batch.toPandas())


def _pages(spark, *rows):
    """Pages of bids (b_id, category, status), as a batch has them."""
    made = [(n, json.dumps({"response": {"response": {"docs": [{"b_id": [b], "b_category_name": c, "b_status": s} for b, c, s in docs]}}}) if docs is not None else "{}") for n, docs in rows]
    return spark.createDataFrame([(f"page {n}", n, body) for n, body in made], "value string, page_num long, body string")


def _state(df):
    return sorted((r["b_id"], r["b_category_name"], r["b_status"]) for r in df.collect())


def test_versions_buckets_and_replays(spark, tmp_path):
    state = str(tmp_path / "state")
    assert read_state(spark, state) is None and read_pages(spark, state).count() == 0
    fold_batch(_pages(spark, (1, [(1, "a", 1), (2, "a", 1), (3, "a", 1)]), (2, None)), 0, state, buckets=3)
    one = [(1, "a", 1), (2, "a", 1), (3, "a", 1)]
    assert _state(read_state(spark, state)) == one
    fold_batch(_pages(spark, (3, [(1, "b", 2), (4, "b", 2)]), (4, [])), 1, state, buckets=5)  # deals the state anew
    two = [(1, "a", 2), (2, "a", 1), (3, "a", 1), (4, "b", 2)]
    assert _state(read_state(spark, state)) == two
    fold_batch(_pages(spark, (3, [(1, "x", 9)])), 1, state, buckets=5)  # a replay after its commit
    fold_batch(_pages(spark, (5, None)), 2, state, buckets=8)  # nothing but another number
    assert _state(read_state(spark, state)) == two and commits.content(spark, state)["buckets"] == 8
    assert _state(read_state(spark, state, batch=0)) == one == _state(read_state(spark, state, version=1))
    assert read_state(spark, state, batch=-1) is None
    before = sorted(map(tuple, read_pages(spark, state).collect()), key=repr)
    assert [(n, ok, v) for n, ok, _, v in before] == [(1, True, 0), (2, False, 0), (3, True, 1), (4, True, 1), (5, False, 2)]
    assert compact_pages(spark, state) == 4 and compact_pages(spark, state) is None
    assert sorted(map(tuple, read_pages(spark, state).collect()), key=repr) == before and len(commits.content(spark, state)["pages"]) == 1
    fold_batch(_pages(spark, (6, [(9, "c", 3)])), 3, state, buckets=8, keep=2)
    assert len(commits.versions(spark, state)) == 2 and _state(read_state(spark, state)) == [*two, (9, "c", 3)]
    assert len(list((tmp_path / "state/pages").iterdir())) == 2


def test_a_batch_that_failed_is_folded_once(spark, tmp_path, monkeypatch):
    """What a run wrote before it died is read by nobody, and its batch is folded from the state before."""
    state = str(tmp_path / "state")
    fold_batch(_pages(spark, (1, [(1, "a", 1)])), 0, state, buckets=2)

    def die(*_):
        raise OSError("gone")

    monkeypatch.setattr(commits, "publish", die)
    batch = _pages(spark, (2, [(1, "b", 5), (2, "b", 5)]))
    try:
        fold_batch(batch, 1, state, buckets=2)
    except OSError:
        pass
    monkeypatch.undo()
    assert _state(read_state(spark, state)) == [(1, "a", 1)] and read_pages(spark, state).count() == 1
    fold_batch(batch, 1, state, buckets=2)
    assert _state(read_state(spark, state)) == [(1, "a", 5), (2, "b", 5)] and read_pages(spark, state).count() == 2


def test_a_page_is_parsed_once(spark, tmp_path, monkeypatch):
    """Not once more for each of its documents, nor for what is told of the page beside them."""
    plans = []

    def seen(docs, *beside):
        plans.append(docs.select("page_num", *beside, "pos", "doc")._jdf.queryExecution().optimizedPlan().toString())
        return flatten_bids(docs, *beside)

    monkeypatch.setattr(ingest, "flatten_bids", seen)
    fold_batch(_pages(spark, (1, [(k, "a", 1) for k in range(1, 31)]), (2, None), (3, [])), 0, str(tmp_path), buckets=2)
    assert plans[0].count("parseJson") == 1
    assert read_state(spark, str(tmp_path)).count() == 30
    assert sorted(map(tuple, read_pages(spark, str(tmp_path)).collect())) == [(1, True, None, 0), (2, False, "page 2", 0), (3, True, None, 0)]


def test_late_events(spark, tmp_path):
    """Late rows land in their own table, closed windows don't change, and the state holds the open ones only."""
    root = str(tmp_path / "rates")
    at = lambda *s: spark.createDataFrame([(x,) for x in s], "s double").selectExpr("cast(timestamp_micros(cast(s * 1000000 as long)) as timestamp_ntz) as ts")
    rates.fold_rates(at(1000.0, 1000.5, 1003.0), 0, root, 30)
    assert rates.closed_windows(spark, root).count() == 0 and rates.open_windows(spark, root).count() == 13
    rates.fold_rates(at(1100.0, 973.0, 972.9), 1, root, 30)
    assert [r["v"] for r in rates.late_events(spark, root).collect()] == [1]
    closed = {r["start"].timestamp(): r["n"] for r in rates.closed_windows(spark, root).collect()}
    assert closed[1000] == 3 and closed[1003] == 1 and closed[991] == 2 and closed[994] == 3 and closed[964] == 1 and max(closed) == 1003
    rates.fold_rates(at(1069.9, 1070.0), 2, root, 30)
    rates.fold_rates(at(1.0), 2, root, 30)  # a replay
    assert rates.late_events(spark, root).count() == 2 and rates.open_windows(spark, root).count() == 20
    for k in range(3, 8):
        rates.fold_rates(at(*[1100.0 + 40 * k + x for x in range(40)]), k, root, 30)
        assert rates.open_windows(spark, root).count() <= 30 + 10 + 1
    rates.fold_rates(spark.createDataFrame([(None,)], "ts timestamp_ntz"), 8, root, 30)
    assert rates.late_events(spark, root).count() == 2
    whole = {r["start"]: r["n"] for r in rate_by_window(at(1000.0, 1000.5, 1003.0, 973.0, 1070.0, 1100.0, *[1100.0 + 40 * k + x for k in range(3, 8) for x in range(40)])).collect()}
    kept = {r["start"]: r["n"] for df in (rates.closed_windows(spark, root), rates.open_windows(spark, root)) for r in df.collect()}
    assert kept == whole


def test_upsert_is_idempotent_and_splits(spark, sf):
    log = fx.observations(spark, sf)
    whole = upsert(log, "b_id", "seq", LAST_WINS)
    twice = upsert(log.union(log), "b_id", "seq", LAST_WINS)
    assert rows_of(whole.toPandas()) == rows_of(twice.toPandas())
    state = upsert(log.where("seq < 300"), "b_id", "seq", LAST_WINS)
    assert rows_of(upsert_batch(state, log.where("seq >= 300"), "b_id", "seq", LAST_WINS).toPandas()) == rows_of(whole.toPandas())
    assert upsert(log.limit(0), "b_id", "seq", LAST_WINS).count() == 0


def test_live_rate(spark, sf, tmp_path):
    fx.table(spark, sf, "events").select("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz").parquet(str(tmp_path / "in"))
    q = rate_by_window(stream, late="3650 days").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows_of(spark.table("rates").toPandas()) == rows_of(rate_by_window(fx.table(spark, sf, "events")).toPandas())
