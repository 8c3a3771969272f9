"""Run queries in Spark and their SQL in DuckDB, and compare the results value by value."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def plain(value: object) -> object:
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        return ("float", "nan" if math.isnan(value) else repr(value))
    if isinstance(value, dt.datetime):
        return ("time", value.isoformat())
    return (type(value).__name__, value if value is None else str(value))


def canonical(names: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    body = sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)
    return [names[i] for i in order], body


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def duckdb_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return canonical(names, cursor.fetchall())


def difference(got: tuple, want: tuple) -> str | None:
    """None when equal, otherwise the first thing that differs."""
    if got[0] != want[0]:
        return f"columns {got[0]} instead of {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows instead of {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            cells = [(n, x, y) for n, x, y in zip(got[0], a, b) if x != y]
            return f"first difference {cells}"
    return None


def main(folder: str, names: list[str]) -> int:
    from checks.oracle import oracles
    from checks.queries import QUERIES
    from shipcause.session import local_session

    spark: SparkSession = local_session(8)
    con, sql = database(folder), oracles()
    bad = 0
    for name in names or QUERIES:
        t0 = time.time()
        try:
            got = spark_rows(QUERIES[name](spark, folder))
            t1 = time.time()
            problem = difference(got, duckdb_rows(con, sql[name])) if name in sql else "no SQL"
            print(f"{name:28} {len(got[1]):8} rows  spark {t1 - t0:6.2f}s  sql {time.time() - t1:6.2f}s  {problem or 'ok'}", flush=True)
        except Exception as e:  # report and go on with the next query
            problem = str(e)
            print(f"{name:28} ERROR {str(e)[:600]}", flush=True)
        bad += problem is not None
    print(f"{bad} of {len(names or QUERIES)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
