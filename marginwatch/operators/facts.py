"""Order-level building blocks.

Reports are defined over the join of an order's item rows with its payment rows, so an
order with i items and p payments counts i x p times. That product is never built: each
side is first reduced to one row per order (and category or seller), and the joined
row count and sums follow from the two row counts. The work stays linear however many
rows one order has, and partial aggregation shrinks a hot order before any shuffle.
Rows of one order id that agree in all columns used are one row with a count as well, so
a repeated order id meets its lines once.

:func:`order_fact` is that join for all reports at once: trends, detectors and root causes
aggregate it, so a full run joins orders, items and payments once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marginwatch.functions.labels import UNKNOWN, canceled
from marginwatch.functions.money import cents, mean, percent, total
from marginwatch.functions.timekeys import whole_days, year_month, year_week

PURCHASED = "order_purchase_timestamp"
DELIVERY = "order_delivered_customer_date"


def order_payments(payments: DataFrame) -> DataFrame:
    """Per order: the cents and number of its non-zero payment rows."""
    return (
        payments.filter(F.col("payment_value") > 0)
        .groupBy("order_id")
        .agg(
            F.sum(cents("payment_value")).alias("paid"),
            F.count(F.lit(1)).alias("payment_rows"),
        )
    )


def product_categories(products: DataFrame, category_xlat: DataFrame, unknown: bool = True) -> DataFrame:
    """product_id and its English category, else its own category, else 'unknown' (or null)."""
    names = [F.col("product_category_name_english"), F.col("product_category_name")]
    if unknown:
        names.append(F.lit(UNKNOWN))
    translation = category_xlat.select("product_category_name", "product_category_name_english")
    return products.join(translation, "product_category_name", "left").select(
        "product_id", F.coalesce(*names).alias("category_en")
    )


def order_lines(items: DataFrame, *keys: str) -> DataFrame:
    """Item rows reduced to one row per order and ``keys``."""
    return items.groupBy("order_id", *keys).agg(F.count(F.lit(1)).alias("item_rows"))


def category_lines(items: DataFrame, categories: DataFrame, *keys: str) -> DataFrame:
    """One row per order, category and ``keys``.

    A best-selling product makes one join key hot; the join feeds an aggregation with
    its own shuffle, so adaptive execution may split that key's rows over tasks.
    """
    needed = ["order_id", "product_id", *keys]
    return order_lines(items.select(*needed).join(categories, "product_id"), "category_en", *keys)


def joined_rows(orders: DataFrame, lines: DataFrame, payments: DataFrame, dedupe: bool = False) -> DataFrame:
    """Distinct order rows with payments and lines, one row per line, carrying fan-out measures.

    ``fan_rows`` is the number of item x payment rows and ``fan_paid`` their summed
    payment value in cents. ``dedupe`` counts every payment once per line instead.
    """
    paid = counted_orders(orders.join(order_payments(payments), "order_id"))
    items = F.col("order_rows") * (F.lit(1) if dedupe else F.col("item_rows"))
    return paid.join(lines, "order_id").withColumns(
        {
            "fan_rows": items * F.col("payment_rows"),
            "fan_paid": items * F.col("paid"),
        }
    )


def counted_orders(orders: DataFrame) -> DataFrame:
    """Equal rows as one with their number. After a join by order id this needs no shuffle of its own."""
    return orders.groupBy(*orders.columns).agg(F.count(F.lit(1)).alias("order_rows"))


def order_week_lines(orders: DataFrame, lines: DataFrame, payments: DataFrame, dedupe: bool = False) -> DataFrame:
    """:func:`joined_rows` of dated orders, whose rows of one order and week are one row.

    No order meets a line twice in a week, so reports by week and a key of the lines count its orders
    as rows; a distinct count would keep every order of a task in memory. ``fan_canceled`` is the part of
    ``fan_rows`` that belongs to cancelled order rows.
    """
    weeks = (
        orders.join(order_payments(payments), "order_id")
        .groupBy("order_id", "year_week", "paid", "payment_rows")
        .agg(F.count(F.lit(1)).alias("order_rows"), F.count_if(canceled()).alias("canceled_orders"))
    )
    items = F.lit(1) if dedupe else F.col("item_rows")
    return weeks.join(lines, "order_id").withColumns(
        {
            "fan_rows": F.col("order_rows") * items * F.col("payment_rows"),
            "fan_paid": F.col("order_rows") * items * F.col("paid"),
            "fan_canceled": F.col("canceled_orders") * items * F.col("payment_rows"),
        }
    )


def paid_orders(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Order rows with ``paid`` and ``payment_rows``, null for orders without a non-zero payment."""
    columns = ["order_id", "customer_id", "order_status", PURCHASED, DELIVERY]
    return orders.select(*columns).join(order_payments(payments), "order_id", "left")


def order_fact(paid: DataFrame, items: DataFrame, products: DataFrame, category_xlat: DataFrame) -> DataFrame:
    """One row per distinct order row, seller and category, with the measures of both sides.

    ``paid`` is :func:`paid_orders`. ``known`` is null for items whose product is not in ``products``,
    the measures of payments are null for orders without any; reports filter what they need.
    ``fan_rows``, ``fan_paid`` and ``fan_listed`` count and sum the item x payment rows,
    ``line_rows`` the item rows alone.
    """
    orders = counted_orders(
        paid.select(
            "order_id",
            "customer_id",
            "order_status",
            year_week(PURCHASED).alias("year_week"),
            year_month(PURCHASED).alias("year_month"),
            whole_days(F.col(DELIVERY), F.col(PURCHASED)).alias("lifecycle_days"),
            "paid",
            "payment_rows",
        )
    )
    categories = product_categories(products, category_xlat, unknown=False).withColumn("known", F.lit(True))
    lines = (
        items.select("order_id", "product_id", "seller_id", "price", "freight_value")
        .join(categories, "product_id", "left")
        .groupBy("order_id", "seller_id", "known", "category_en")
        .agg(
            F.count(F.lit(1)).alias("item_rows"),
            F.sum(cents("price") + cents("freight_value")).alias("listed"),
        )
    )
    return orders.join(lines, "order_id").select(
        "order_id",
        "customer_id",
        "order_status",
        "year_week",
        "year_month",
        "lifecycle_days",
        "seller_id",
        "known",
        "category_en",
        (F.col("order_rows") * F.col("item_rows")).alias("line_rows"),
        (F.col("order_rows") * F.col("item_rows") * F.col("payment_rows")).alias("fan_rows"),
        (F.col("order_rows") * F.col("item_rows") * F.col("paid")).alias("fan_paid"),
        (F.col("order_rows") * F.col("payment_rows") * F.col("listed")).alias("fan_listed"),
    )


def priced_lines(fact: DataFrame) -> DataFrame:
    """Paid rows of known products; the missing category is named."""
    rows = fact.filter(F.col("fan_rows").isNotNull() & F.col("known"))
    return rows.withColumn("category_en", F.coalesce("category_en", F.lit(UNKNOWN)))


def canceled_rows() -> Column:
    return F.sum(F.when(canceled(), F.col("fan_rows")).otherwise(F.lit(0)))


def mean_paid(digits: int = 2) -> Column:
    return mean(F.sum("fan_paid"), F.sum("fan_rows"), digits)


def canceled_pct(digits: int) -> Column:
    return percent(canceled_rows(), F.sum("fan_rows"), digits)


def fan_revenue() -> Column:
    return total("fan_paid")


def orders_with(orders: DataFrame, keys: Sequence[Column], *columns: str) -> DataFrame:
    """Order columns plus computed keys, dropping everything else before the shuffles."""
    return orders.select("order_id", "order_status", *columns, *keys)
