"""Every query against its SQL."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, rows_of_duckdb, rows_of_spark

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_same_rows(spark, con, name):
    got = rows_of_spark(entry.QUERIES[name](spark, FOLDER))
    if name in entry.ORACLES:
        assert got == rows_of_duckdb(con, entry.ORACLES[name])
    else:
        assert got[0]


def test_contract(spark):
    assert entry.entry(spark).columns == ["uid", "mid", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
