"""Every registered query against its SQL oracle in another engine."""

import pytest

import __spark_entry__ as contract
from eventskim.plans import oracles, queries

from .compare import assert_same, connect

QUERIES, ORACLES = queries.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, con, name):
    assert assert_same(QUERIES[name](spark, sf_dir), con, ORACLES[name]) > 0


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:3] == ["Electron_runNum", "Electron_lumisec", "Electron_evtNum"]
    assert df.count() > 0
