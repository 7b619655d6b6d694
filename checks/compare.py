"""Run queries against their SQL in DuckDB: ``python -m checks.compare [--sf DIR] [names...]``."""

from __future__ import annotations

import argparse
import glob
import math
import os
import time

import duckdb
from pyspark.sql import SparkSession

from checks import CHECKS, SQL
from finescale.session import configure

DEFAULT_DIR = "/root/testdata/sf0.01"


def session(cpus: int = 8) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName("checks")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g"))
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(repr, r)))


def compare(spark, con, sf_dir: str, name: str) -> str:
    t0 = time.time()
    df = CHECKS[name](spark, sf_dir)
    got = df.collect()
    took = time.time() - t0
    if name not in SQL:
        return f"rows-only {len(got)} rows {took:.1f}s"
    cur = con.execute(SQL[name])
    cols, want = [c[0] for c in cur.description], cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"DIFF columns {sorted(set(cols) ^ set(df.columns))}"
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(cols, want)
    types = {c[0]: str(c[1]) for c in cur.description}
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return (f"DIFF rows {len(a)} vs {len(b)}, {len(bad)} differ; columns {sorted(cols)}; "
                f"first {bad[:2]}; types {df.dtypes} vs {types}")
    wide = [c for c, t in types.items() if "HUGEINT" in t or "DECIMAL" in t]
    note = f" TYPES {wide}" if wide else ""
    return f"ok {len(a)} rows {took:.1f}s{note}"


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default=DEFAULT_DIR)
    args = ap.parse_args()
    spark, con = session(), duck(args.sf)
    for name in args.names or CHECKS:
        try:
            line = compare(spark, con, args.sf, name)
        except Exception as e:                                  # keep going, report all
            line = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {line}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
