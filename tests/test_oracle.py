"""Every catalog query against its SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SMALL
from turnloom.plans.catalog import QUERIES

TABLES = ("conversations", "documents", "supplier")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    """The library's own queries all have SQL; the training-data ones only where it can express them."""
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    result = duck.execute(oracle_sql()[name])
    head = [d[0] for d in result.description]
    assert sorted(head) == columns
    want = sorted((tuple(r[head.index(c)] for c in columns) for r in result.fetchall()), key=repr)
    assert got == want
