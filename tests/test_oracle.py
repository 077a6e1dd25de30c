"""Every registered query against its SQL on another engine."""

import pytest
from compare import compare, connect

from bourselake.plans import catalog

QUERIES = catalog.bound_queries()
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    problem = compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert problem is None, problem
