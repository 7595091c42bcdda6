"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

Usage: python tools/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _sorted_rows(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return [columns[i] for i in order], sorted(picked, key=lambda r: tuple((v is not None, str(v)) for v in r))


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both sides give the same columns and rows, else what differs."""
    got_columns, got = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_columns, want = _sorted_rows([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows; first {got[:2]} / {want[:2]}"
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            if x != y or (isinstance(x, float) != isinstance(y, float)):
                return f"row {a} != {b}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from pyspark.sql import SparkSession

    from skysift.plans import queries as registered

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(args.sf), registered.oracle_sql(), 0
    for name, run in registered.queries().items():
        if args.names and name not in args.names:
            continue
        start = time.time()
        try:
            df = run(spark, args.sf)
            verdict = difference(df, con, sqls[name]) if name in sqls else f"no SQL, {df.count()} rows"
        except Exception as problem:
            verdict = f"failed: {problem}"[:1500]
            if args.names:
                traceback.print_exc()
        good = verdict is None or verdict.startswith("no SQL")
        bad += not good
        print(f"{'ok ' if good else 'BAD'} {name:26s} {time.time() - start:6.2f}s {verdict or ''}", flush=True)
    print(f"{bad} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
