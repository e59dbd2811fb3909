"""Run registered queries next to their SQL in DuckDB and compare the values.

Usage: python -m tests.compare [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def spark_session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("yieldloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
        )
    return connection


def norm(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, int) and not isinstance(value, bool):
        return str(value)
    return value if value is None else str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def check(spark: SparkSession, folder: str, name: str, connection=None) -> tuple[str, int, float]:
    """('match' | 'rows-only' | difference text, row count, seconds)."""
    start = time.time()
    frame = entry.queries()[name](spark, folder)
    columns = frame.columns
    got = [tuple(r) for r in frame.collect()]
    seconds = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "rows-only", len(got), seconds
    result = (connection or duck(folder)).execute(sql)
    want_columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(columns) != sorted(want_columns):
        return f"columns {sorted(columns)} != {sorted(want_columns)}", len(got), seconds
    left, right = rows_of(columns, got), rows_of(want_columns, want)
    if left == right:
        return "match", len(got), seconds
    extra = [r for r in left if r not in set(right)][:3]
    missing = [r for r in right if r not in set(left)][:3]
    return (
        f"{len(left)} vs {len(right)} rows\n    spark: {extra}\n    sql:   {missing}",
        len(got),
        seconds,
    )


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark, connection = spark_session(), duck(folder)
    bad = 0
    for name in args.names or entry.queries():
        try:
            state, rows, seconds = check(spark, folder, name, connection)
        except Exception as exc:  # noqa: BLE001 - report and go on
            state, rows, seconds = f"ERROR {str(exc)[:1500]}", -1, 0.0
        bad += state not in ("match", "rows-only")
        print(f"{name:28s} {rows:8d} {seconds:6.2f}s {state}", flush=True)
    print("failing:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
