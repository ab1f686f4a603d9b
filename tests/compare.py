"""Runs registered queries against their SQL in DuckDB. Usage: compare.py SF [name ...]"""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TESTDATA = "/root/testdata"


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[:-len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        if value == int(value) and abs(value) < 1e15:
            return int(value)
        return float(f"{value:.10g}")
    if isinstance(value, decimal.Decimal):
        return plain(float(value))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = canon(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return len(got) > 0, f"rows-only {len(got)} rows", t1 - t0
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want_cols, want = canon(cols, cur.fetchall())
    t2 = time.time()
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}", t1 - t0
    if got != want:
        bad = next((i for i, (a, b) in enumerate(zip(got, want)) if a != b), min(len(got), len(want)))
        detail = f"rows {len(got)} vs {len(want)}; first difference at {bad}:"
        if bad < len(got):
            detail += f"\n   spark {got[bad]}"
        if bad < len(want):
            detail += f"\n   sql   {want[bad]}"
        return False, detail, t1 - t0
    if not got:
        return False, "no rows on either side", t1 - t0
    return True, f"{len(got)} rows, sql {t2 - t1:.1f}s", t1 - t0


def main(argv):
    import __spark_entry__ as entry
    from sealwright.session import build_session
    sf_dir = f"{TESTDATA}/{argv[0]}"
    names = argv[1:]
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    failed, total = [], 0.0
    for name, fn in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        try:
            ok, text, sec = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as exc:  # report and go on
            ok, text, sec = False, f"{type(exc).__name__}: {str(exc)[:1500]}", 0.0
        total += sec
        print(f"{'ok  ' if ok else 'FAIL'} {name:36s} {sec:6.2f}s  {text}", flush=True)
        if not ok:
            failed.append(name)
    print(f"total {total:.1f}s, failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
