"""Compares registered queries with their SQL twins in DuckDB."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(cols), sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got), df
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got), df
    if got != want:
        miss = [r for r in want if r not in set(got)][:3]
        extra = [r for r in got if r not in set(want)][:3]
        return f"{len(got)} rows vs {len(want)}; only sql {miss}; only spark {extra}", len(got), df
    types = [type(v) for r in want[:1] for v in r], [type(v) for r in got[:1] for v in r]
    if types[0] != types[1]:
        return f"types {types}", len(got), df
    return None, len(got), df


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from footfall.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    names = sys.argv[1:] or list(e.queries())
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            err, rows, _ = compare(spark, con, n, e.queries()[n], e.oracle_sql().get(n), sf)
        except Exception as x:  # report and go on
            err, rows = f"{type(x).__name__}: {str(x)[:700]}", -1
        bad += err is not None
        kind = "sql" if n in e.oracle_sql() else "rows"
        print(f"{'FAIL' if err else 'ok  '} {n} {kind} {rows} rows {time.time() - t0:.2f}s {err or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    spark.stop()
