"""Every query with SQL, on the smallest data set, compared row by row."""

import duckdb
import pytest

from tallyloom.catalog import ORACLES, QUERIES
from tools.check import TABLES, rows_of


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows_of(columns, cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() == 5
    assert QUERIES.keys() <= e.queries().keys() and ORACLES.items() <= e.oracle_sql().items()
