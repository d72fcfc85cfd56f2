"""Queries against the SQL stating their results, on the smallest tables."""

import duckdb
import pytest

from tallyloom.llm.queries import ORACLES, QUERIES

TABLES = ("documents", "pages", "conversations", "labels", "benchmark", "embeddings")


def canonical(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    got = df.collect()
    cur = db.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(canonical(r[columns.index(c)]) for c in sorted(columns)) for r in cur.fetchall())
    assert sorted(tuple(canonical(r[c]) for c in sorted(columns)) for r in got) == want
    assert len(got) > 0


def test_all_are_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
