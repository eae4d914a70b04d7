"""Every registered query against its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from suite import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return check.oracle_connection(SF)


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, connection, name):
    difference = check.compare(
        spark, connection, entry.queries()[name], entry.oracle_sql().get(name), SF
    )
    assert difference == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
