"""The ledger of attempts: claims, crashes, settlements and races."""

import pytest
from pyspark.sql import functions as F

from tenderlake.operators import ledger


def _tries(spark, *rows):
    return spark.createDataFrame(list(rows), "page_num long, attempt int, ok boolean")


def _states(spark, root, version=None):
    return {r["page_num"]: (r["state"], r["claims"]) for r in ledger.states(spark, root, version).collect()}


@pytest.fixture
def root(spark, tmp_path):
    root = f"file://{tmp_path}/ledger"
    ledger.record(_tries(spark, (1, 0, True), (2, 0, False), (3, 3, False), (4, 3, False), (4, 1, False), (None, 3, False), (5, 3, True)), root)
    return root


def test_states(spark, root):
    assert _states(spark, root) == {1: ("done", 0), 2: ("retry", 0), 3: ("dead", 0), 4: ("dead", 0), 5: ("done", 0)}
    ledger.record(_tries(spark, (2, 3, False), (2, 3, False), (1, 3, False)), root)
    assert _states(spark, root)[2] == ("dead", 0) and _states(spark, root)[1] == ("done", 0) and _states(spark, root, 1)[2] == ("retry", 0)


def test_a_rescrape_clears_what_succeeds(spark, root):
    number = ledger.claim(spark, root)
    assert sorted(r["page_num"] for r in ledger.claimed(spark, root, number).collect()) == [3, 4]
    assert ledger.claim(spark, root) is None  # all are taken
    ledger.settle(_tries(spark, (3, 0, False), (3, 1, True), (4, 3, False), (2, 0, True)), root, number)
    assert _states(spark, root) == {1: ("done", 0), 2: ("retry", 0), 3: ("done", 1), 4: ("dead", 1), 5: ("done", 0)}
    again = ledger.claim(spark, root)
    ledger.settle(_tries(spark, (4, 2, False)), root, again)  # given up early: still dead
    assert _states(spark, root)[4] == ("dead", 2)


def test_a_crash_between_claim_and_settlement_loses_none(spark, root):
    first = ledger.claim(spark, root)
    assert _states(spark, root)[3] == ("claimed", 1)
    ledger.release(spark, root, first)
    second = ledger.claim(spark, root)
    assert sorted(r["page_num"] for r in ledger.claimed(spark, root, second).collect()) == [3, 4]
    # the first run wasn't gone after all: its success counts, its failure doesn't end the second's claim
    ledger.settle(_tries(spark, (3, 0, True), (4, 3, False)), root, first)
    assert _states(spark, root)[3] == ("done", 2) and _states(spark, root)[4] == ("claimed", 2)
    ledger.settle(_tries(spark, (4, 0, True)), root, second)
    assert _states(spark, root)[4] == ("done", 2)


def test_two_runs_that_claim_at_once(spark, root, monkeypatch):
    """The second finds its version taken, looks again, and gets nothing."""
    before, real = [], ledger.states

    def late(*args):
        out = real(*args)
        if not before:
            before.append(True)
            before.append(ledger.claim(spark, root))
        return out

    monkeypatch.setattr(ledger, "states", late)
    assert ledger.claim(spark, root) is None and before[1] is not None


def test_no_attempts(spark, tmp_path):
    root = f"file://{tmp_path}/none"
    assert ledger.states(spark, root).count() == 0 and ledger.claim(spark, root) is None
    ledger.record(_tries(spark).where(F.lit(False)), root)
    assert ledger.states(spark, root).count() == 0
