"""Run registered queries in Spark and their oracle in DuckDB, compare values.

Usage: python -m tests.compare [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import sys
import time
from concurrent.futures import ThreadPoolExecutor, as_completed
from decimal import Decimal

import duckdb

from petrigrid.catalog.fixtures import BASE

ROOT = "/root/testdata"


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, Decimal):
        return f"D{v}"
    if isinstance(v, float):
        return f"f{v + 0.0!r}"
    if isinstance(v, dt.datetime):
        return f"t{v.replace(tzinfo=None).isoformat()}"
    return f"{type(v).__name__}:{v}"


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - t
    if sql is None:
        return name, "rows-only", len(got), took, ""
    con = duck(sf_dir)
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return name, "COLUMNS", len(got), took, f"{sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return name, "ok" if a else "EMPTY", len(got), took, ""
    if len(a) != len(b):
        sa, sb = set(a), set(b)
        return name, "ROWCOUNT", len(got), took, f"{len(a)} vs {len(b)}; spark-only {sorted(sa - sb)[:3]}; duck-only {sorted(sb - sa)[:3]}"
    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return name, "VALUES", len(got), took, f"{sorted(cols)} {diff}"


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--threads", type=int, default=4)
    ap.add_argument("names", nargs="*")
    a = ap.parse_args(argv)
    import __spark_entry__ as entry
    from petrigrid.session import build_session

    spark = build_session("compare")
    qs, sqls = entry.queries(), entry.oracle_sql()
    picked = [n for n in qs if not a.names or any(n.startswith(p) for p in a.names)]
    sf_dir = f"{ROOT}/sf{a.sf}"

    def one(n):
        try:
            return compare(spark, n, qs[n], sqls.get(n), sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            return n, "ERROR", 0, 0.0, f"{type(e).__name__}: {str(e)[:1200]}"

    bad = 0
    with ThreadPoolExecutor(a.threads) as pool:
        for done in as_completed([pool.submit(one, n) for n in picked]):
            n, status, rows, took, note = done.result()
            good = status in ("ok", "rows-only")
            bad += not good
            print(f"{'  ' if good else '!!'} {n:34s} {status:9s} {rows:7d} {took:6.1f}s {note}", flush=True)
    print(f"{len(picked)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
