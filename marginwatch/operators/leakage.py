"""Dedicated leakage detectors L1 to L4 and the revenue at risk they find."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from marginwatch.functions.labels import L1, L2, L3, L4, canceled, delivered
from marginwatch.functions.money import amount, cents, percent, total
from marginwatch.functions.timekeys import whole_days, year_week
from marginwatch.operators import facts
from marginwatch.operators.baseline import history, rolling, rolling_mean
from marginwatch.operators.metrics import order_discounts
from marginwatch.operators.quantile import quantile_scalars
from marginwatch.rules import RULES

PURCHASED = "order_purchase_timestamp"
DELIVERY = "order_delivered_customer_date"


def discount_abuse(
    orders: DataFrame,
    items: DataFrame,
    payments: DataFrame,
    threshold_pct: float = RULES.discount_pct,
    dedupe: bool = False,
) -> DataFrame:
    """L1: delivered orders that paid more than ``threshold_pct`` below list price."""
    return abuse_of(order_discounts(orders, items, payments, dedupe), threshold_pct)


def abuse_of(discounts: DataFrame, threshold_pct: float = RULES.discount_pct) -> DataFrame:
    """:func:`discount_abuse` of order discounts."""
    per_order = discounts.groupBy("order_id").agg(
        F.sum("list_price").alias("listed"), F.sum("actual_paid").alias("paid")
    )
    return per_order.select(
        "order_id",
        amount("listed").alias("list_price"),
        amount("paid").alias("actual_paid"),
        percent(F.col("listed") - F.col("paid"), F.col("listed")).alias("discount_pct"),
    ).filter(F.col("discount_pct") > threshold_pct)


def as_detections(flags: DataFrame, leakage_type: str) -> DataFrame:
    """Flags with their leakage type and a detection marker."""
    return flags.withColumns({"leakage_type": F.lit(leakage_type), "detected": F.lit(True)})


def refund_rates(
    orders: DataFrame, items: DataFrame, products: DataFrame, category_xlat: DataFrame
) -> DataFrame:
    """Cancelled item rows per hundred orders, by category and week; uncategorised rows drop out."""
    categories = facts.product_categories(products, category_xlat, unknown=False)
    lines = facts.category_lines(items, categories.filter(F.col("category_en").isNotNull()))
    dated = facts.orders_with(
        orders.filter(F.col(PURCHASED).isNotNull()), [year_week(PURCHASED).alias("year_week")]
    )
    rows = facts.counted_orders(dated).join(lines, "order_id")
    return refund_rates_of(rows.withColumn("line_rows", F.col("order_rows") * F.col("item_rows")))


def refund_rates_of(rows: DataFrame) -> DataFrame:
    """:func:`refund_rates` of order lines with ``line_rows``; those without a week or category drop out."""
    return (
        rows.filter(F.col("year_week").isNotNull() & F.col("category_en").isNotNull())
        .groupBy("year_week", "category_en")
        .agg(
            F.count_distinct("order_id").alias("total_orders"),
            F.sum(F.when(canceled(), F.col("line_rows")).otherwise(F.lit(0))).alias("cancellations"),
        )
        .withColumn("cancel_rate_pct", percent(F.col("cancellations"), F.col("total_orders")))
    )


def refund_baseline(
    rates: DataFrame,
    weeks: int = RULES.window_weeks,
    min_weeks: int = RULES.min_weeks,
    sigmas: float = RULES.refund_sigmas,
) -> DataFrame:
    """Each category's cancellation rate against its own recent weeks."""
    window = history(weeks)
    rate = F.col("cancel_rate_pct")
    z = (rate - F.col("rolling_cancel_mean")) / F.nullif(F.col("rolling_cancel_std"), F.lit(0.0))
    return rates.withColumns(
        {
            "rolling_cancel_mean": rolling_mean(rate, window, min_weeks),
            "rolling_cancel_std": rolling(rate, F.stddev_samp(rate).over(window), window, min_weeks),
        }
    ).withColumns({"cancel_z_score": z, "is_refund_spike": F.coalesce(z > sigmas, F.lit(False))})


def refund_spikes(
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    category_xlat: DataFrame,
    weeks: int = RULES.window_weeks,
    min_weeks: int = RULES.min_weeks,
    sigmas: float = RULES.refund_sigmas,
) -> DataFrame:
    """L2: category weeks whose cancellation rate spikes."""
    return spikes_of(refund_rates(orders, items, products, category_xlat), weeks, min_weeks, sigmas)


def spikes_of(rates: DataFrame, weeks: int, min_weeks: int, sigmas: float) -> DataFrame:
    """:func:`refund_spikes` of weekly rates."""
    return refund_baseline(rates, weeks, min_weeks, sigmas).filter("is_refund_spike")


def silent_churn(
    totals: DataFrame,
    min_days: int = RULES.churn_days,
    min_orders: int = RULES.churn_min_orders,
    quantile: float = RULES.high_value_quantile,
) -> DataFrame:
    """L3: high-value customers without an order for ``min_days`` before the data's last order.

    ``totals`` holds lifetime value, order count and last order per person, all statuses.
    """
    (high_value,) = quantile_scalars(totals, "lifetime_value", [quantile])
    last_day = totals.agg(F.max("last_order_date")).scalar()
    return (
        totals.withColumns(
            {
                "is_high_value": F.col("lifetime_value") >= high_value,
                "days_inactive": whole_days(last_day, F.col("last_order_date")),
            }
        )
        .withColumn(
            "is_churned",
            F.coalesce(
                F.col("is_high_value")
                & (F.col("days_inactive") >= min_days)
                & (F.col("total_orders") >= min_orders),
                F.lit(False),
            ),
        )
        .filter("is_churned")
    )


def _lifecycles(orders: DataFrame) -> DataFrame:
    """Days from purchase to delivery of delivered orders; negative when dates are swapped."""
    return orders.filter(delivered() & F.col(DELIVERY).isNotNull() & F.col(PURCHASED).isNotNull()).select(
        "order_id", "order_status", whole_days(F.col(DELIVERY), F.col(PURCHASED)).alias("lifecycle_days")
    )


def short_lifecycle_orders(
    orders: DataFrame,
    items: DataFrame,
    payments: DataFrame,
    products: DataFrame,
    category_xlat: DataFrame,
    days: int = RULES.short_days,
    slice_rows: int = 10_000,
) -> DataFrame:
    """L4 rows of orders delivered in fewer than ``days`` days: one per item and payment row.

    The row grain is the product of an order's items and payments by definition. Use
    :func:`short_lifecycle_flags` where sums or order ids are wanted. An order with more than
    ``slice_rows`` items is counted before the join, its items are dealt to slices of that size, and its
    payments go to each slice, so several tasks build its rows.
    """
    heavy = (
        items.groupBy("order_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > slice_rows)
        .select("order_id", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices"))
    )
    short = _lifecycles(orders).filter(F.col("lifecycle_days") < days).drop("order_status")
    categories = facts.product_categories(products, category_xlat, unknown=False)
    paid = payments.filter(F.col("payment_value") > 0).select(
        "order_id", amount(cents("payment_value")).alias("payment_value")
    )
    slices = F.coalesce("slices", F.lit(1))
    lines = (
        items.select("order_id", "product_id", "seller_id", F.monotonically_increasing_id().alias("n"))
        .join(heavy, "order_id", "left")
        .select("order_id", "product_id", "seller_id", F.pmod("n", slices).cast("int").alias("slice"))
        .join(categories, "product_id")
    )
    sent = short.join(paid, "order_id").join(heavy, "order_id", "left")
    sent = sent.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("slices")
    return (
        lines.join(sent, ["order_id", "slice"])
        .select("order_id", "seller_id", "category_en", "lifecycle_days", "payment_value")
    )


def lifecycle_lines(
    orders: DataFrame, items: DataFrame, payments: DataFrame, products: DataFrame, category_xlat: DataFrame
) -> DataFrame:
    """Delivered orders by seller and category with lifecycle and fan-out measures."""
    categories = facts.product_categories(products, category_xlat, unknown=False)
    lines = facts.category_lines(items, categories, "seller_id")
    return facts.joined_rows(_lifecycles(orders), lines, payments)


def fact_lifecycle_lines(fact: DataFrame) -> DataFrame:
    """:func:`lifecycle_lines` from the shared fact."""
    rows = fact.filter(delivered() & F.col("lifecycle_days").isNotNull() & F.col("fan_rows").isNotNull() & F.col("known"))
    return rows.select("order_id", "order_status", "lifecycle_days", "seller_id", "category_en", "fan_rows", "fan_paid")


def short_lifecycle_flags(lines: DataFrame, days: int = RULES.short_days) -> DataFrame:
    """L4 flags without the row product: one row per order, seller and category.

    ``flag_rows`` and ``payment_value`` are the count and sum of the rows that
    :func:`short_lifecycle_orders` would give.
    """
    return lines.filter(F.col("lifecycle_days") < days).select(
        "order_id",
        "seller_id",
        "category_en",
        "lifecycle_days",
        F.col("fan_rows").alias("flag_rows"),
        amount("fan_paid").alias("payment_value"),
    )


def short_lifecycle_sellers(
    lines: DataFrame,
    days: int = RULES.seller_short_days,
    min_rate_pct: float = RULES.seller_short_rate_pct,
    min_rows: int = RULES.seller_min_rows,
) -> DataFrame:
    """L4 first version: seller-category pairs with a high share of short lifecycles."""
    short = F.when(F.col("lifecycle_days") < days, F.col("fan_rows")).otherwise(F.lit(0))
    return (
        lines.filter(F.col("seller_id").isNotNull() & F.col("category_en").isNotNull())
        .groupBy("seller_id", "category_en")
        .agg(
            F.sum("fan_rows").alias("total_orders"),
            F.sum(short).alias("short_orders"),
            facts.fan_revenue().alias("revenue"),
        )
        .withColumn("short_rate_pct", percent(F.col("short_orders"), F.col("total_orders"), 1))
        .filter((F.col("short_rate_pct") >= min_rate_pct) & (F.col("total_orders") >= min_rows))
    )


def _totals(flags: DataFrame, detector: str, rows: Column, amount: Column | None) -> DataFrame:
    amount = F.lit(None).cast("double") if amount is None else F.coalesce(total(amount), F.lit(0.0))
    return flags.agg(F.coalesce(rows, F.lit(0)).alias("flags"), amount.alias("revenue_at_risk")).select(
        F.lit(detector).alias("detector"), "flags", "revenue_at_risk"
    )


def detector_totals(l1: DataFrame, l2: DataFrame, l3: DataFrame, l4_flags: DataFrame) -> DataFrame:
    """Flag rows and revenue at risk per detector; L2 carries no amount."""
    count = F.count(F.lit(1))
    return reduce(
        DataFrame.unionByName,
        [
            _totals(l1, L1, count, cents("actual_paid")),
            _totals(l2, L2, count, None),
            _totals(l3, L3, count, cents("lifetime_value")),
            _totals(l4_flags, L4, F.sum("flag_rows"), cents("payment_value")),
        ],
    )


def revenue_at_risk(totals: DataFrame) -> DataFrame:
    """Revenue at risk of L1, L3 and L4 and their total."""
    amounts = totals.filter(F.col("revenue_at_risk").isNotNull()).select("detector", "revenue_at_risk")
    everything = amounts.agg(total(cents("revenue_at_risk")).alias("revenue_at_risk"))
    return amounts.unionByName(everything.select(F.lit("total").alias("detector"), "revenue_at_risk"))
