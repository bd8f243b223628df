"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python tests/compare.py sf0.01|<folder> [query,query,...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        if not os.path.exists(f"{base}/{table}.parquet"):
            continue
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{base}/{table}.parquet'")
    return con


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows with columns in name order, sorted, for an order-free comparison."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    # repr keeps 1 and 1.0 apart, so types are compared as well.
    unequal = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    if unequal:
        return f"{len(unequal)} of {len(got)} rows differ, e.g.\n    {unequal[0][0]}\n    {unequal[0][1]}"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    base = sys.argv[1] if "/" in sys.argv[1] else f"/root/testdata/{sys.argv[1]}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracle = duck(base), entry.queries(), entry.oracle_sql()
    chosen = sys.argv[2].split(",") if len(sys.argv) > 2 else list(oracle)
    failed = 0
    for name in chosen:
        started = time.time()
        problem = difference(queries[name](spark, base), con, oracle[name])
        failed += problem is not None
        print(f"{name:26s} {time.time() - started:6.2f}s {problem or 'equal'}", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} equal")
    return failed


if __name__ == "__main__":
    sys.exit(main())
