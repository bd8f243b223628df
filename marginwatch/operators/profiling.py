"""Table profiles and previews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def profile_table(df: DataFrame, name: str) -> DataFrame:
    """One row per column: table rows and columns, and the column's null count.

    A single pass; the wide aggregate is one row and is turned to long form after it.
    """
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns],
    )
    return counts.unpivot("__rows", df.columns, "column_name", "null_count").select(
        F.lit(name).alias("table_name"),
        F.col("__rows").alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        "column_name",
        "null_count",
    )


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [profile_table(df, name) for name, df in tables.items()])


def preview(df: DataFrame, rows: int = 2) -> DataFrame:
    """A few rows, in no particular order."""
    return df.limit(rows)


def first_rows(df: DataFrame, rows: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(rows)


def last_rows(df: DataFrame, rows: int, key: str) -> DataFrame:
    """The last rows by ``key``, in ascending order."""
    return df.orderBy(F.desc(key)).limit(rows).orderBy(key)
