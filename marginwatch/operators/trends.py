"""Revenue trends by week, category, region and customer tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginwatch.functions.labels import delivered, tier
from marginwatch.functions.money import amount, cents, mean, percent, total
from marginwatch.functions.timekeys import year_week
from marginwatch.operators import facts
from marginwatch.operators.quantile import quantile_scalars
from marginwatch.operators.ranking import percent_ranks
from marginwatch.rules import RULES

PURCHASED = "order_purchase_timestamp"


def weekly_revenue(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Delivered revenue by week with the change from the week before.

    The window has no partition key, but its input is one row per calendar week.
    """
    return weeks_of(orders.select("order_id", "order_status", PURCHASED).join(facts.order_payments(payments), "order_id"))


def weeks_of(paid: DataFrame) -> DataFrame:
    """:func:`weekly_revenue` of orders with payments."""
    weekly = (
        paid.filter(delivered() & F.col(PURCHASED).isNotNull())
        .groupBy(year_week(PURCHASED).alias("year_week"))
        .agg(F.sum("paid").alias("revenue"), F.count_distinct("order_id").alias("orders_count"))
    )
    previous = F.lag("revenue").over(Window.orderBy("year_week"))
    change = F.col("revenue") - F.col("previous")
    return (
        weekly.withColumn("previous", previous)
        .select(
            "year_week",
            amount("revenue").alias("weekly_revenue"),
            "orders_count",
            amount("previous").alias("prev_week_revenue"),
            amount(change).alias("wow_change"),
            percent(change, F.col("previous")).alias("wow_pct"),
        )
        .orderBy("year_week")
    )


def _dated_orders(orders: DataFrame) -> DataFrame:
    dated = orders.filter(F.col(PURCHASED).isNotNull())
    return facts.orders_with(dated, [year_week(PURCHASED).alias("year_week")])


def category_weekly(
    orders: DataFrame,
    items: DataFrame,
    payments: DataFrame,
    products: DataFrame,
    category_xlat: DataFrame,
    dedupe: bool = False,
) -> DataFrame:
    """Orders, revenue, mean payment and cancelled rows by category and week, all statuses.

    ``dedupe`` counts a payment once per category of its order, not once per item.
    """
    lines = facts.category_lines(items, facts.product_categories(products, category_xlat))
    rows = facts.order_week_lines(_dated_orders(orders), lines, payments, dedupe)
    return _category_weeks(rows, F.count(F.lit(1)), F.sum("fan_canceled"))


def category_weeks_of(rows: DataFrame) -> DataFrame:
    """:func:`category_weekly` of the shared fact's rows."""
    dated = rows.filter(F.col("year_week").isNotNull())
    return _category_weeks(dated, F.count_distinct("order_id"), facts.canceled_rows())


def _category_weeks(rows: DataFrame, orders: Column, cancellations: Column) -> DataFrame:
    return rows.groupBy("year_week", "category_en").agg(
        orders.alias("orders_count"),
        facts.fan_revenue().alias("weekly_revenue"),
        facts.mean_paid().alias("avg_order_value"),
        cancellations.alias("cancellations"),
    )


def full_weeks(weekly: DataFrame, orders: DataFrame) -> DataFrame:
    """``weekly`` without the week of the last purchase, unless that purchase is on the week's last day."""
    next_day = orders.agg(year_week(F.max(PURCHASED) + F.expr("INTERVAL 1 DAY"))).scalar()
    return weekly.filter(F.col("year_week") < next_day)


def geo_weekly(
    orders: DataFrame, items: DataFrame, payments: DataFrame, sellers: DataFrame, dedupe: bool = False
) -> DataFrame:
    """Orders, revenue and cancelled rows by seller state and week; ``dedupe`` as for categories."""
    located = items.select("order_id", "seller_id").join(sellers.select("seller_id", "seller_state"), "seller_id")
    lines = facts.order_lines(located, "seller_state")
    rows = facts.order_week_lines(_dated_orders(orders), lines, payments, dedupe)
    return _state_weeks(rows, F.count(F.lit(1)), F.sum("fan_canceled"))


def fact_state_weeks(fact: DataFrame, sellers: DataFrame) -> DataFrame:
    """:func:`geo_weekly` from the shared fact."""
    paid = fact.filter(F.col("fan_rows").isNotNull())
    located = paid.join(sellers.select("seller_id", "seller_state"), "seller_id")
    dated = located.filter(F.col("year_week").isNotNull())
    return _state_weeks(dated, F.count_distinct("order_id"), facts.canceled_rows())


def _state_weeks(rows: DataFrame, orders: Column, cancellations: Column) -> DataFrame:
    return rows.groupBy("year_week", "seller_state").agg(
        orders.alias("orders_count"),
        facts.fan_revenue().alias("weekly_revenue"),
        cancellations.alias("cancellations"),
    )


def customer_totals(orders: DataFrame, payments: DataFrame, customers: DataFrame) -> DataFrame:
    """Lifetime value, order count and last order per person.

    Orders are first reduced to their customer record. The join on customer_id needs
    that shuffle anyway, and a record or person with a huge share of the orders has
    shrunk to one row per task by then.
    """
    paid = orders.select("order_id", "customer_id", PURCHASED).join(facts.order_payments(payments), "order_id")
    return totals_of(paid, customers)


def totals_of(paid: DataFrame, customers: DataFrame) -> DataFrame:
    """:func:`customer_totals` of orders with payments."""
    per_record = (
        paid.groupBy("customer_id")
        .agg(
            F.sum("paid").alias("paid"),
            F.count_distinct("order_id").alias("orders"),
            F.max(PURCHASED).alias("last_order"),
        )
    )
    return (
        customers.select("customer_id", "customer_unique_id")
        .join(per_record, "customer_id")
        .groupBy("customer_unique_id")
        .agg(
            F.max("last_order").alias("last_order_date"),
            F.sum("orders").alias("total_orders"),
            total("paid").alias("lifetime_value"),
        )
    )


def customer_tiers(ltv: DataFrame, quantiles: tuple[float, float] = RULES.tier_quantiles) -> DataFrame:
    """Low/Mid/High tier of each person by the lifetime value of their delivered orders."""
    ltv = ltv.select("customer_unique_id", "lifetime_value")
    q40, q80 = quantile_scalars(ltv, "lifetime_value", quantiles)
    return ltv.withColumn("tier", tier(F.col("lifetime_value"), q40, q80))


def ranked_customers(
    ltv: DataFrame, shares: tuple[float, float] = RULES.tier_quantiles, ranges: int | None = None
) -> DataFrame:
    """Percent rank of each person's lifetime value, and the tier that follows from it.

    A person is High from the first value whose rank reaches the upper share, Mid from the lower one.
    Unlike :func:`customer_tiers` the borders are values that occur, not interpolated ones.
    """
    ranked = percent_ranks(ltv, "lifetime_value", "customer_unique_id", ranges)
    rank = F.col("percent_rank")
    name = F.when(rank >= shares[1], "High").when(rank >= shares[0], "Mid").when(rank.isNotNull(), "Low")
    return ranked.select("customer_unique_id", "lifetime_value", "percent_rank", name.alias("tier"))


def tier_summary(tiers: DataFrame) -> DataFrame:
    """Customers, revenue and mean value per tier that occurs."""
    value = cents("lifetime_value")
    return (
        tiers.filter(F.col("tier").isNotNull())
        .groupBy("tier")
        .agg(
            F.count("customer_unique_id").alias("customer_count"),
            total(value).alias("total_revenue"),
            mean(F.sum(value), F.count(F.lit(1))).alias("avg_ltv"),
        )
        .orderBy(F.desc("avg_ltv"))
    )
