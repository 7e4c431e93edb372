"""Compare queries with their SQL on DuckDB: python tests/check_oracles.py [sf] [name-part ...]"""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else (0.0 if v == 0 else v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr), [cols[i] for i in order]


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, sf_dir, name, fn, sql):
    t = time.time()
    df = fn(spark, sf_dir)
    got, gc = rows_of(df.columns, [tuple(x) for x in df.collect()])
    took = time.time() - t
    if sql is None:
        return f"rows-only {len(got)} rows", took, True
    t = time.time()
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want, wc = rows_of(cols, rel.fetchall())
    took_sql = time.time() - t
    if gc != wc:
        return f"COLUMNS {set(gc) ^ set(wc)}", took, False
    if len(got) != len(want):
        return f"ROWS {len(got)} != {len(want)}", took, False
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        a, b = bad[0]
        diff = [(c, x, y) for c, x, y in zip(gc, a, b) if x != y][:4]
        types = [(c, type(x).__name__, type(y).__name__) for c, x, y in zip(gc, a, b) if type(x) is not type(y)]
        return f"VALUES {len(bad)}/{len(got)} e.g. {a[:3]} {diff} {types}", took, False
    return f"ok {len(got)} rows, sql {took_sql:.1f}s", took, True


def main():
    from marketweave.session import local_session

    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = e.oracle_sql()
    failed = 0
    for name, fn in e.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            text, took, ok = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as exc:  # report and go on with the next query
            text, took, ok = f"ERROR {type(exc).__name__} {str(exc)[:600]}", 0.0, False
        failed += not ok
        if not ok or "-q" not in os.environ.get("CHECK", ""):
            print(f"{'  ' if ok else '!!'} {name:40s} {took:6.1f}s {text}", flush=True)
    print("failed:", failed)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
