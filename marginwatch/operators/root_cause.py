"""Root causes of flagged category weeks, for all targets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from marginwatch.functions.labels import UNKNOWN
from marginwatch.functions.timekeys import year_week
from marginwatch.operators import facts

PURCHASED = "order_purchase_timestamp"
TARGET = ["year_week", "category_en"]


def rca_targets(anomalies: DataFrame, n: int = 10) -> DataFrame:
    """The anomalies with the most revenue at risk."""
    return (
        anomalies.select(*TARGET, F.col("revenue_at_risk").alias("revenue_gap"), "z_score")
        .orderBy(F.desc("revenue_gap"), "category_en", "year_week")
        .limit(n)
    )


def target_rows(
    targets: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    payments: DataFrame,
    categories: DataFrame,
) -> DataFrame:
    """Order rows of the targets' weeks and categories, by category and seller.

    The targets' weeks cut the orders and their categories cut the products before the
    large joins; the pair is matched at the end.
    """
    weeks = targets.select("year_week").distinct()
    names = targets.select("category_en").distinct()
    dated = facts.orders_with(
        orders.filter(F.col(PURCHASED).isNotNull()), [year_week(PURCHASED).alias("year_week")], "customer_id"
    ).join(weeks, "year_week", "left_semi")
    lines = facts.category_lines(items, categories.join(names, "category_en", "left_semi"), "seller_id")
    return facts.joined_rows(dated, lines, payments).join(targets.select(*TARGET), TARGET, "left_semi")


def fact_target_rows(targets: DataFrame, fact: DataFrame) -> DataFrame:
    """:func:`target_rows` from the shared fact."""
    return facts.priced_lines(fact).join(targets.select(*TARGET), TARGET, "left_semi")


def by_state(rows: DataFrame, sellers: DataFrame) -> DataFrame:
    """Orders, revenue and cancelled rows per target and seller state."""
    return (
        rows.join(sellers.select("seller_id", "seller_state"), "seller_id")
        .groupBy(*TARGET, "seller_state")
        .agg(
            F.count_distinct("order_id").alias("orders"),
            facts.fan_revenue().alias("revenue"),
            facts.canceled_rows().alias("cancellations"),
        )
    )


def by_seller(rows: DataFrame, sellers: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` sellers per target with the most cancelled rows, least revenue first."""
    worst = Window.partitionBy(*TARGET).orderBy(F.desc("cancellations"), F.asc("revenue"), "seller_id")
    return (
        rows.join(sellers.select("seller_id", "seller_state", "seller_city"), "seller_id")
        .groupBy(*TARGET, "seller_id", "seller_state", "seller_city")
        .agg(
            F.count_distinct("order_id").alias("orders"),
            facts.fan_revenue().alias("revenue"),
            facts.canceled_rows().alias("cancellations"),
            facts.canceled_pct(1).alias("cancel_rate_pct"),
        )
        .withColumn("seller_rank", F.row_number().over(worst))
        .filter(F.col("seller_rank") <= n)
    )


def by_tier(rows: DataFrame, customers: DataFrame, tiers: DataFrame) -> DataFrame:
    """Rows and revenue per target and customer tier; customers without a tier drop out."""
    people = customers.select("customer_id", "customer_unique_id")
    return (
        rows.join(people, "customer_id")
        .join(tiers.select("customer_unique_id", "tier"), "customer_unique_id", "left")
        .filter(F.col("tier").isNotNull())
        .groupBy(*TARGET, "tier")
        .agg(F.sum("fan_rows").alias("orders"), facts.fan_revenue().alias("revenue"))
    )


def rca_report(targets: DataFrame, states: DataFrame, worst_sellers: DataFrame) -> DataFrame:
    """One recommendation per target from its largest state and its worst seller."""
    largest = Window.partitionBy(*TARGET).orderBy(F.desc("revenue"), "seller_state")
    top_state = (
        states.withColumn("state_rank", F.row_number().over(largest))
        .filter(F.col("state_rank") == 1)
        .select(*TARGET, F.col("seller_state").alias("root_cause_state"))
    )
    top_seller = worst_sellers.filter(F.col("seller_rank") == 1).select(
        *TARGET,
        F.col("seller_id").cast("string").alias("root_cause_seller"),
        F.col("cancel_rate_pct").alias("seller_cancel_rate"),
    )
    known = (
        targets.join(top_state, TARGET, "left")
        .join(top_seller, TARGET, "left")
        .fillna({"root_cause_state": UNKNOWN, "root_cause_seller": UNKNOWN, "seller_cancel_rate": 0.0})
    )
    return known.select(
        "year_week",
        F.col("category_en").alias("category"),
        "revenue_gap",
        "z_score",
        "root_cause_state",
        "root_cause_seller",
        "seller_cancel_rate",
        F.format_string(
            "Investigate seller %s in %s — cancel rate %s%% in %s during %s",
            F.substring("root_cause_seller", 1, 8),
            F.col("root_cause_state"),
            F.col("seller_cancel_rate").cast("string"),
            F.col("category_en"),
            F.col("year_week"),
        ).alias("recommended_action"),
    ).orderBy(F.desc("revenue_gap"), "category", "year_week")
