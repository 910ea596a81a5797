"""Runs registered queries beside their SQL statements and compares all values.

    python tests/compare.py [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf):
    """None when equal, else what differs."""
    df = query(spark, sf)
    columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if sum(got.values()) else "no rows"
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    wrong = {c: (t, kinds.get(c)) for c, t in df.dtypes if TYPES.get(t) != kinds.get(c)}
    if wrong:
        return f"types differ: {wrong}"
    result = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in result.description], result.fetchall())
    if columns != want_columns:
        return f"columns {columns} != {want_columns}"
    if got != want:
        extra, missing = got - want, want - got
        return f"{sum(extra.values())}/{sum(got.values())} rows differ: {list(extra)[:3]} != {list(missing)[:3]}"
    return None


def main(names):
    import __spark_entry__ as entry
    from millrace.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    con = duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            problem = compare(spark, con, name, queries[name], oracles.get(name), sf)
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
            if names:
                traceback.print_exc()
        bad += problem is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
        spark.catalog.clearCache()
    print(f"{bad} of {len(names or queries)} failed; {len(oracles)} with SQL")


if __name__ == "__main__":
    main(sys.argv[1:])
