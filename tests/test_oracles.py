"""Every query of the library against its SQL twin."""

import pytest

from catalith.plans import catalog
from tests import oracle


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, con, sf, name):
    oracle.same(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], sf)


def test_entry_point_has_them_all(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(catalog.ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
