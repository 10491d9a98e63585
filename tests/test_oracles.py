"""Every registered query against its SQL on the smallest tables."""

import pytest

from oracle import compare, duck
from tokenloom.catalog import load

SF = "/root/testdata/sf0.001"
REGISTRY = load()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(REGISTRY.QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, message = compare(spark, con, SF, REGISTRY.QUERIES[name], REGISTRY.ORACLES.get(name))
    assert ok, message


def test_entry_is_registered():
    import __spark_entry__ as entry

    assert entry.FLAGSHIP in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
