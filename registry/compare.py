"""Side-by-side run of registered queries and their SQL.

    python -m registry.compare [--sf-dir DIR] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import tempfile
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from .oracles import oracle_sql
from .queries import queries


def duckdb_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value: object) -> object:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    return str(value)


def normalised(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    return df.columns, [tuple(r) for r in df.collect()]


def duckdb_rows(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def difference(spark: SparkSession, sf_dir: str, connection: duckdb.DuckDBPyConnection, name: str) -> str | None:
    """None if both sides agree, else what differs."""
    got_names, got = spark_rows(queries()[name](spark, sf_dir))
    want_names, want = duckdb_rows(connection, oracle_sql()[name])
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    left, right = normalised(got_names, got), normalised(want_names, want)
    wrong = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tablewarden-compare-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb_tables(args.sf_dir)
    failed = 0
    for name in args.names or list(queries()):
        start = time.perf_counter()
        try:
            found = difference(spark, args.sf_dir, connection, name)
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            found = f"{type(e).__name__}: {str(e)[:600]}"
        failed += found is not None
        print(f"{time.perf_counter() - start:6.2f}s {name}: {'ok' if found is None else found}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
