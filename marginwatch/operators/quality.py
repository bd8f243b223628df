"""Data-quality report: table, column, issue, share of affected rows, note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marginwatch.functions.labels import delivered
from marginwatch.functions.money import percent

DELIVERY = "order_delivered_customer_date"


def _finding(table: str, column: str, issue: str, pct: Column, note: Column) -> Column:
    return F.struct(
        F.lit(table).alias("table"),
        F.lit(column).alias("column"),
        F.lit(issue).alias("issue"),
        pct.alias("pct_affected"),
        note.alias("note"),
    )


def _count_note(count: str, text: str) -> Column:
    return F.concat(F.col(count).cast("string"), F.lit(" " + text))


def _order_findings(orders: DataFrame) -> DataFrame:
    columns = orders.columns
    counts = orders.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(delivered() & F.col(DELIVERY).isNull()).alias("undated"),
        F.count_if(F.col(DELIVERY) < F.col("order_purchase_timestamp")).alias("impossible"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns],
    )
    n = F.col("n")
    findings = [
        F.when(
            F.col(f"null_{c}") > 0,
            _finding(
                "orders",
                c,
                "nulls",
                percent(F.col(f"null_{c}"), n),
                F.concat(F.format_string("%.1f", percent(F.col(f"null_{c}"), n, 1)), F.lit("% of rows are null")),
            ),
        )
        for c in columns
    ]
    findings += [
        _finding(
            "orders",
            DELIVERY,
            "logical inconsistency",
            percent(F.col("undated"), n),
            _count_note("undated", "orders marked delivered but have no delivery date"),
        ),
        _finding(
            "orders",
            DELIVERY,
            "impossible date",
            percent(F.col("impossible"), n, 4),
            _count_note("impossible", "orders delivered before they were purchased"),
        ),
    ]
    return counts.select(F.inline(F.array_compact(F.array(*findings))))


def _duplicate_finding(orders: DataFrame) -> DataFrame:
    """Rows beyond the first per order_id; a null id counts as one value.

    Kept apart from the other order checks so that only the id is shuffled.
    """
    per_id = orders.groupBy("order_id").agg(F.count(F.lit(1)).alias("cnt"))
    counts = per_id.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).alias("dup"),
    )
    finding = _finding(
        "orders",
        "order_id",
        "duplicates",
        percent(F.col("dup"), F.col("n"), 4),
        _count_note("dup", "duplicate order_ids found"),
    )
    return counts.select(F.inline(F.array(finding)))


def _value_finding(df: DataFrame, table: str, column: str, bad: Column, issue: str, text: str) -> DataFrame:
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"))
    finding = _finding(table, column, issue, percent(F.col("bad"), F.col("n")), _count_note("bad", text))
    return counts.select(F.inline(F.array(finding)))


def _corrupt_findings(corrupt: DataFrame) -> DataFrame:
    """One finding per table with malformed records; their share is unknown here, their number is not."""
    counts = corrupt.groupBy("table").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "table",
        F.lit("*").alias("column"),
        F.lit("malformed records").alias("issue"),
        F.lit(None).cast("double").alias("pct_affected"),
        _count_note("n", "records could not be parsed and were set aside").alias("note"),
    )


def quality_report(
    orders: DataFrame, items: DataFrame, payments: DataFrame, corrupt: DataFrame | None = None
) -> DataFrame:
    """All findings; ``corrupt`` holds records set aside on loading as (table, record)."""
    zero_pay = _value_finding(
        payments,
        "order_payments",
        "payment_value",
        F.col("payment_value") == 0,
        "zero value",
        "payment rows with value = 0",
    )
    free_items = _value_finding(
        items,
        "order_items",
        "price",
        F.col("price") <= 0,
        "zero or negative price",
        "items with price <= 0",
    )
    report = (
        _order_findings(orders)
        .unionByName(zero_pay)
        .unionByName(free_items)
        .unionByName(_duplicate_finding(orders))
    )
    return report if corrupt is None else report.unionByName(_corrupt_findings(corrupt))
