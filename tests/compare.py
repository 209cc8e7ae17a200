"""Runs queries beside their SQL checks: python tests/compare.py [--sf 0.01] [prefix ...]"""

from __future__ import annotations

import argparse
import os
import sys
import threading
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def session() -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").appName("compare")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, folder):
    t = time.time()
    df = fn(spark, folder)
    got = rows_of(df.columns, df.collect())
    spent = time.time() - t
    if os.environ.get("TRACE"):
        print("  spark done", round(spent, 2), flush=True)
    if sql is None:
        return f"rows-only {len(got)} rows", spent, 0.0
    t = time.time()
    timer = threading.Timer(60, con.interrupt)
    timer.start()
    try:
        rel = con.execute(sql)
    finally:
        timer.cancel()
    cols = [d[0] for d in rel.description]
    want = rows_of(cols, rel.fetchall())
    check = time.time() - t
    if sorted(cols) != sorted(df.columns):
        return f"FAIL columns {sorted(df.columns)} vs {sorted(cols)}", spent, check
    if got != want:
        gs, ws = set(got), set(want)
        extra, missing = sorted(gs - ws)[:3], sorted(ws - gs)[:3]
        return (f"FAIL {len(got)} vs {len(want)} rows, differing {len(gs - ws)}/{len(ws - gs)}\n   cols {sorted(cols)}"
                f"\n   spark {extra}\n   sql   {missing}"), spent, check
    return f"ok {len(got)} rows", spent, check


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry
    folder = f"/root/testdata/sf{args.sf}"
    spark, con = session(), duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    sqls, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        try:
            verdict, spent, check = compare(spark, con, name, fn, sqls.get(name), folder)
        except Exception as e:  # noqa: BLE001
            text = str(e).split("JVM stacktrace")[0][:900]
            verdict, spent, check = f"FAIL {type(e).__name__}: {text}", 0.0, 0.0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if verdict.startswith("FAIL"):
            bad.append(name)
        print(f"{name:32s} {spent:6.2f}s sql {check:6.2f}s  {verdict}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
