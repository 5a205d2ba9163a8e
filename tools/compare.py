"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python tools/compare.py [--sf sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import glob
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lookout import catalog  # noqa: E402


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, may_be_empty=False) -> tuple[bool, str]:
    t = time.time()
    df = catalog.QUERIES[name](spark, folder)
    got = df.collect()
    took = time.time() - t
    if name not in catalog.SQL:
        return may_be_empty or len(got) > 0, f"{len(got)} rows, no SQL, {took:.1f}s"
    rel = con.sql(catalog.SQL[name])
    names = rel.columns
    want = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        return False, f"{len(got)} vs {len(want)} rows; only spark {list((a - b).items())[:3]}; only sql {list((b - a).items())[:3]}"
    return may_be_empty or len(got) > 0, f"{len(got)} rows, {took:.1f}s"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    folder = f"/root/testdata/{args.sf}"
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    spark = session()
    bad = []
    for name in args.names or catalog.QUERIES:
        try:
            ok, note = compare(spark, con, folder, name)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
