"""Run registered queries beside their DuckDB statements and report differences.

    python tests/compare.py [--sf DIR] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry_point  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def build_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("compare")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return f"{value:.6f}"
    if value is None:
        return "\0"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def main() -> int:
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in args:
        at = args.index("--sf")
        sf_dir = args[at + 1]
        del args[at : at + 2]
    queries, oracle = entry_point.queries(), entry_point.oracle_sql()
    names = args or list(queries)
    spark = build_session()
    con = connect(sf_dir)
    bad = 0
    for name in names:
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got = rows_of(df.columns, df.collect())
        except Exception as error:  # noqa: BLE001
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            bad += 1
            continue
        took = time.time() - began
        if name not in oracle:
            print(f"ROWS  {name}: {len(got)} rows, {took:.1f}s", flush=True)
            continue
        try:
            began = time.time()
            cursor = con.execute(oracle[name])
            columns = [d[0] for d in cursor.description]
            want = rows_of(columns, cursor.fetchall())
            sql_took = time.time() - began
        except Exception as error:  # noqa: BLE001
            print(f"SQLERR {name}: {str(error)[:1500]}", flush=True)
            bad += 1
            continue
        if sorted(columns) != sorted(df.columns) or got != want:
            bad += 1
            print(f"DIFF  {name}: {len(got)} vs {len(want)} rows", sorted(df.columns), sorted(columns))
            extra, missing = sorted(set(got) - set(want)), sorted(set(want) - set(got))
            print("   only spark:", len(extra), extra[:3])
            print("   only sql:  ", len(missing), missing[:3], flush=True)
        else:
            print(f"ok    {name}: {len(got)} rows, spark {took:.1f}s, sql {sql_took:.1f}s", flush=True)
    print(f"{bad} bad of {len(names)}")
    return bad


if __name__ == "__main__":
    sys.exit(main())
