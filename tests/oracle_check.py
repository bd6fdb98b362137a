"""Run the registered queries on Spark and their SQL on DuckDB, and compare.

    python -m tests.oracle_check [folder] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from __spark_entry__ import oracle_sql, queries
from tsweave.session import local_session


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return value if value is None else str(value)


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=str)


def compare(spark, con, name: str, folder: str) -> tuple[str, int, float, list]:
    started = time.time()
    df = queries()[name](spark, folder)
    got = df.collect()
    seconds = time.time() - started
    sql = oracle_sql().get(name)
    if sql is None:
        return "rows only", len(got), seconds, []
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    want_rows = want.fetchall()
    if sorted(names) != sorted(df.columns):
        return "COLUMNS DIFFER", len(got), seconds, [sorted(names), sorted(df.columns)]
    a = canonical(df.columns, [tuple(r) for r in got])
    b = canonical(names, want_rows)
    differ = [(x, y) for x, y in zip(a, b) if x != y]
    if len(a) != len(b) or differ:
        return "DIFFERS", len(got), seconds, [len(a), len(b), len(differ), *differ[:3]]
    return "same", len(got), seconds, []


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(8), duck(folder)
    names = sys.argv[2:] or list(queries())
    bad = 0
    for name in names:
        try:
            status, rows, seconds, detail = compare(spark, con, name, folder)
        except Exception as e:
            status, rows, seconds, detail = "FAILED", 0, 0.0, [str(e)[:1500]]
        bad += status not in ("same", "rows only")
        print(f"{name:32s} {status:14s} {rows:8d} rows {seconds:7.2f} s", *detail, flush=True)
    print("problems:", bad)
