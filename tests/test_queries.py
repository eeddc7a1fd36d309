"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry
from relaylens.plans import catalogue
from tests.compare import connect, differences
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_a_twin():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry_has_all_queries():
    assert set(catalogue.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, con, name):
    assert differences(catalogue.QUERIES[name](spark, SMALL), con, catalogue.ORACLES[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
