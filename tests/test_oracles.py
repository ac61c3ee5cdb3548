"""Every registered query that has SQL against that SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CORE = [n for m in entry._MODULES for n in __import__(m, fromlist=["QUERIES"]).QUERIES]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    if name in entry.oracle_sql():
        assert compare(df, duck, entry.oracle_sql()[name]) == ""
    else:
        assert df.count() >= 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
