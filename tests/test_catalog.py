"""Every query of the catalogue against its SQL."""

import pytest
from oracle import MAY_BE_EMPTY, same

from tenderlake.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    same(catalog.QUERIES[name](spark, sf), catalog.ORACLE_SQL[name], sf, name in MAY_BE_EMPTY)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
