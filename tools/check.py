"""Run registered queries beside their SQL on the same Parquet files and compare all rows.

usage: python tools/check.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyloom.catalog import ORACLES, QUERIES  # noqa: E402
from tallyloom.sources.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


WHOLE = ("TINYINT", "SMALLINT", "INTEGER", "BIGINT")
SAME = {"int": WHOLE, "bigint": WHOLE, "smallint": WHOLE, "double": ("DOUBLE",), "string": ("VARCHAR",),
        "boolean": ("BOOLEAN",)}


def canonical(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if v != v:
            return "nan"
        return str(int(v)) if v.is_integer() and abs(v) < 1e15 else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canonical(x) for x in v) + "]"
    if type(v).__name__ == "Decimal":
        return canonical(float(v))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("prefixes", nargs="*")
    args = parser.parse_args()
    names = [n for n in QUERIES if not args.prefixes or any(n.startswith(p) for p in args.prefixes)]
    spark, bad = local_session(8), 0
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{args.sf}/{t}.parquet'")
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, args.sf)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows {name}: {len(got)} rows, {took:.1f}s", flush=True)
                continue
            start = time.time()
            cur = db.execute(ORACLES[name])
            names_sql = [d[0] for d in cur.description]
            want = cur.fetchall()
            sql_took = time.time() - start
            if sorted(df.columns) != sorted(names_sql):
                raise ValueError(f"columns {sorted(df.columns)} vs {sorted(names_sql)}")
            kinds = {d[0]: str(d[1]) for d in cur.description}
            odd = [(f.name, f.dataType.simpleString(), kinds[f.name]) for f in df.schema.fields
                   if kinds[f.name] not in SAME.get(f.dataType.simpleString(), (kinds[f.name],))]
            a, b = rows_of(df.columns, got), rows_of(names_sql, want)
            if a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                raise ValueError(f"{len(a)} vs {len(b)} rows; first differences {diff}")
            print(f"ok   {name}: {len(a)} rows, {took:.1f}s, sql {sql_took:.1f}s"
                  + (f" TYPES {odd}" if odd else ""), flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"BAD  {name}: {type(e).__name__}: {str(e)[:900]}", flush=True)
    print(f"{len(names)} run, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
