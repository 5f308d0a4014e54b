"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_point
from strandline.plans import REGISTRY
from tests.compare import TESTDATA, database, differences

SF_DIR = os.path.join(TESTDATA, "sf0.001")
QUERIES = {name: q.build for name, q in REGISTRY.items()}
SQL = {name: q.sql for name, q in REGISTRY.items() if q.sql is not None}


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, SQL[name]) == []


def test_entry_gives_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_entry_lists_every_query():
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(SQL) <= set(entry_point.oracle_sql())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
