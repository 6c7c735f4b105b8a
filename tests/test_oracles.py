"""Every core query against its SQL on the smallest tables; queries without SQL must run and keep their columns."""

import pytest

from foliospark.queries import ORACLES, QUERIES
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, data, con, name):
    same(QUERIES[name](spark, data), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0
