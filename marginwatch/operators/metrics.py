"""Revenue KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginwatch.functions.labels import canceled, delivered
from marginwatch.functions.money import amount, cents, mean, percent, total
from marginwatch.functions.timekeys import year_month
from marginwatch.operators import facts

PURCHASED = "order_purchase_timestamp"


def _counted_once(rows: DataFrame, measures: dict[str, Column], *keys: str) -> DataFrame:
    """One row per ``keys`` and customer: sums of ``measures``, and ``orders`` to be summed.

    An order counts with the first of its customers, so summed orders are distinct ones and the
    rows with a customer are distinct customers. Two distinct counts in one aggregate would triple
    every row and shuffle it again.
    """
    per_order = rows.groupBy("order_id", *keys, "customer_id").agg(
        *[F.sum(measure).alias(name) for name, measure in measures.items()]
    )
    place = F.row_number().over(Window.partitionBy("order_id", *keys).orderBy("customer_id"))
    return (
        per_order.withColumn("first", (place == 1).cast("int"))
        .groupBy(*keys, "customer_id")
        .agg(F.sum("first").alias("orders"), *[F.sum(name).alias(name) for name in measures])
    )


def overall_kpis(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders, customers, gross, net and cancelled revenue, mean payment, cancellation rate."""
    return kpis_of(orders.select("order_id", "customer_id", "order_status").join(facts.order_payments(payments), "order_id"))


def kpis_of(paid: DataFrame) -> DataFrame:
    """:func:`overall_kpis` of orders with payments."""
    conditions = {"kept": F.col("order_status") != "canceled", "delivered": delivered(), "canceled": canceled()}
    measures = {"rows": F.col("payment_rows")}
    for name, condition in conditions.items():
        measures[f"{name}_paid"] = F.when(condition, F.col("paid"))
        measures[f"{name}_rows"] = F.when(condition, F.col("payment_rows"))

    def all_of(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    return _counted_once(paid, measures).agg(
        all_of("orders").alias("total_orders"),
        F.count("customer_id").alias("total_customers"),
        amount(all_of("kept_paid")).alias("gmv"),
        amount(all_of("delivered_paid")).alias("net_revenue"),
        amount(all_of("canceled_paid")).alias("cancelled_revenue"),
        mean(all_of("delivered_paid"), all_of("delivered_rows")).alias("avg_order_value"),
        percent(all_of("canceled_rows"), F.sum("rows")).alias("cancellation_rate_pct"),
    )


def monthly_revenue(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Delivered revenue by purchase month."""
    columns = ["order_id", "customer_id", "order_status", PURCHASED]
    return months_of(orders.select(*columns).join(facts.order_payments(payments), "order_id"))


def months_of(paid: DataFrame) -> DataFrame:
    """:func:`monthly_revenue` of orders with payments."""
    paid = paid.filter(delivered() & F.col(PURCHASED).isNotNull()).withColumn("year_month", year_month(PURCHASED))
    measures = {"paid": F.col("paid"), "payment_rows": F.col("payment_rows")}
    return (
        _counted_once(paid, measures, "year_month")
        .groupBy("year_month")
        .agg(
            F.sum("orders").alias("orders_count"),
            total("paid").alias("monthly_revenue"),
            mean(F.sum("paid"), F.sum("payment_rows")).alias("monthly_aov"),
            F.count("customer_id").alias("unique_customers"),
        )
        .orderBy("year_month")
    )


def monthly_refund_rate(orders: DataFrame) -> DataFrame:
    """Share of cancelled orders by purchase month."""
    return (
        orders.filter(F.col(PURCHASED).isNotNull())
        .groupBy(year_month(PURCHASED).alias("year_month"))
        .agg(F.count(F.lit(1)).alias("total_orders"), F.count_if(canceled()).alias("cancelled_orders"))
        .withColumn("refund_rate_pct", percent(F.col("cancelled_orders"), F.col("total_orders")))
        .orderBy("year_month")
    )


def order_discounts(orders: DataFrame, items: DataFrame, payments: DataFrame, dedupe: bool = False) -> DataFrame:
    """List price and amount paid per delivered order, in cents.

    Both are sums over the order's item x payment rows, so each side is scaled by the
    other's row count. ``dedupe`` counts every item and payment once instead.
    """
    # One list-price sum per order; no category is involved.
    listed = items.groupBy("order_id").agg(
        F.sum(cents("price") + cents("freight_value")).alias("listed"),
        F.count(F.lit(1)).alias("item_rows"),
    )
    times_paid, times_listed = (F.lit(1), F.lit(1)) if dedupe else (F.col("item_rows"), F.col("payment_rows"))
    return (
        orders.filter(delivered())
        .select("order_id", PURCHASED)
        .join(facts.order_payments(payments), "order_id")
        .join(listed, "order_id")
        .select(
            "order_id",
            PURCHASED,
            (times_listed * F.col("listed")).alias("list_price"),
            (times_paid * F.col("paid")).alias("actual_paid"),
        )
    )


def discount_depth(orders: DataFrame, items: DataFrame, payments: DataFrame, dedupe: bool = False) -> DataFrame:
    """How far payments fall below list prices, by purchase month (which may be null)."""
    rows = order_discounts(orders, items, payments, dedupe)
    return depth_of(rows.withColumn("year_month", year_month(PURCHASED)))


def fact_discounts(fact: DataFrame) -> DataFrame:
    """:func:`order_discounts` from the shared fact: per order and month."""
    rows = fact.filter(delivered() & F.col("fan_rows").isNotNull())
    return rows.select("order_id", "year_month", F.col("fan_listed").alias("list_price"), F.col("fan_paid").alias("actual_paid"))


def depth_of(rows: DataFrame) -> DataFrame:
    """:func:`discount_depth` of order discounts with their month."""
    gap = F.sum("list_price") - F.sum("actual_paid")
    return (
        rows.groupBy("year_month")
        .agg(
            F.count_distinct("order_id").alias("orders_count"),
            total("list_price").alias("total_list_price"),
            total("actual_paid").alias("total_paid"),
            percent(gap, F.sum("list_price")).alias("discount_depth_pct"),
        )
        .orderBy("year_month")
    )


def category_revenue(
    orders: DataFrame,
    items: DataFrame,
    payments: DataFrame,
    products: DataFrame,
    category_xlat: DataFrame,
    dedupe: bool = False,
) -> DataFrame:
    """Orders, revenue, mean payment and cancellation rate per category, all statuses.

    ``dedupe`` counts a payment once per category of its order, not once per item.
    """
    lines = facts.category_lines(items, facts.product_categories(products, category_xlat))
    return categories_of(facts.joined_rows(facts.orders_with(orders, []), lines, payments, dedupe))


def categories_of(rows: DataFrame) -> DataFrame:
    """:func:`category_revenue` of joined rows."""
    return rows.groupBy("category_en").agg(
        F.count_distinct("order_id").alias("orders_count"),
        facts.fan_revenue().alias("total_revenue"),
        facts.mean_paid().alias("avg_order_value"),
        facts.canceled_pct(2).alias("cancel_rate_pct"),
    )


def top_categories(category_totals: DataFrame, n: int = 20) -> DataFrame:
    return category_totals.orderBy(F.desc("total_revenue"), "category_en").limit(n)


def near_zero_payments(payments: DataFrame, below: float = 1.0) -> DataFrame:
    """Total paid by orders whose payments sum to less than ``below``."""
    per_order = payments.groupBy("order_id").agg(F.sum(cents("payment_value")).alias("paid"))
    return per_order.filter(amount("paid") < below).agg(total("paid").alias("val"))
