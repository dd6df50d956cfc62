import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parent.parent))

import brute  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return brute.corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names clash with those of results, and with columns inside the operators."""
    wide = [(d, t, "q", d, 1) for d, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, n_words string, key long, _found int").repartition(5)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
