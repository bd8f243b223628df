"""Planting labelled leakage in clean tables.

Each function returns a few chosen order ids or the changed table. Choices are the first
rows in a hash order of the id, so they repeat exactly. A choice has at most ``n`` rows,
which the planner sees, so it broadcasts the usual few hundred and would shuffle many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginwatch.functions.draws import digest, draw
from marginwatch.functions.labels import CANCELED, L1, L2, L3, L4
from marginwatch.functions.money import amount, cents
from marginwatch.functions.timekeys import iso_week
from marginwatch.operators.quantile import quantile_scalars

PURCHASED = "order_purchase_timestamp"
DELIVERY = "order_delivered_customer_date"
Tables = dict[str, DataFrame]


def sample_orders(orders: DataFrame, n: int, tag: str) -> DataFrame:
    """Up to ``n`` order ids out of a table of distinct ids."""
    return orders.select("order_id").orderBy(digest(tag, F.col("order_id")), "order_id").limit(n)


def _marked(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """Left join with the chosen ids; ``hit`` is true on their rows and null elsewhere."""
    return df.join(chosen.withColumn("hit", F.lit(True)), "order_id", "left")


def _replaced(df: DataFrame, chosen: DataFrame, column: str, new: Column) -> DataFrame:
    kept = df.columns
    value = F.when(F.col("hit"), new).otherwise(F.col(column))
    return _marked(df, chosen).withColumn(column, value).select(*kept)


def discount_targets(payments: DataFrame, n: int = 200) -> DataFrame:
    return sample_orders(payments.select("order_id").distinct(), n, L1)


def scale_payments(payments: DataFrame, chosen: DataFrame, low: float = 0.4, high: float = 0.6) -> DataFrame:
    """Multiply every payment of the chosen orders by its own factor between low and high."""
    paid = cents("payment_value")
    # Factors have four decimals, so the scaled cents are exact until they are rounded.
    pick = draw(digest(L1, F.col("order_id"), paid)) % (round((high - low) * 10000) + 1)
    scaled = F.floor((paid * (pick + round(low * 10000)) + 5000) / 10000)
    return _replaced(payments, chosen, "payment_value", amount(scaled))


def refund_targets(
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    category: str,
    weeks: tuple[int, int] = (30, 35),
    n: int = 150,
) -> DataFrame:
    """Orders holding the category (by its own name) bought in the given ISO weeks of any year."""
    wanted = products.filter(F.col("product_category_name") == category).select("product_id")
    holding = items.join(wanted, "product_id", "left_semi").select("order_id")
    in_weeks = orders.filter(iso_week(PURCHASED).between(*weeks)).select("order_id")
    return sample_orders(in_weeks.join(holding, "order_id", "left_semi").distinct(), n, L2)


def cancel_orders(orders: DataFrame, chosen: DataFrame) -> DataFrame:
    return _replaced(orders, chosen, "order_status", F.lit(CANCELED))


def churn_targets(
    orders: DataFrame, payments: DataFrame, quantile: float = 0.80, months: int = 6, n: int = 300
) -> DataFrame:
    """Recent orders of the customer records that spent the most."""
    spent = payments.groupBy("order_id").agg(F.sum(cents("payment_value")).alias("spent"))
    per_record = (
        orders.select("order_id", "customer_id")
        .join(spent, "order_id")
        .groupBy("customer_id")
        .agg(amount(F.sum("spent")).alias("ltv"))
    )
    (threshold,) = quantile_scalars(per_record, "ltv", [quantile])
    best = per_record.filter(F.col("ltv") >= threshold).select("customer_id")
    cutoff = orders.agg((F.max(PURCHASED) - F.make_ym_interval(F.lit(0), F.lit(months))).alias("cutoff")).scalar()
    recent = orders.filter(F.col(PURCHASED) >= cutoff).select("order_id", "customer_id")
    return sample_orders(recent.join(best, "customer_id", "left_semi").select("order_id").distinct(), n, L3)


def delete_orders(orders: DataFrame, chosen: DataFrame) -> DataFrame:
    return orders.join(chosen, "order_id", "left_anti")


def lifecycle_targets(items: DataFrame, seller_rank: int = 6, n: int = 100) -> DataFrame:
    """Orders of the seller with the ``seller_rank``-th most item rows."""
    largest = (
        items.groupBy("seller_id")
        .count()
        .orderBy(F.desc("count"), "seller_id")
        .limit(seller_rank)
        .withColumn("place", F.row_number().over(Window.orderBy(F.desc("count"), "seller_id")))
        .filter(F.col("place") == seller_rank)
        .select("seller_id")
    )
    orders = items.select("order_id", "seller_id").join(largest, "seller_id", "left_semi")
    return sample_orders(orders.select("order_id").distinct(), n, L4)


def shorten_lifecycles(orders: DataFrame, chosen: DataFrame, days: int = 15) -> DataFrame:
    delivery = F.col(PURCHASED) + F.make_dt_interval(F.lit(days))
    return _replaced(orders, chosen, DELIVERY, delivery)


def labels_table(targets: dict[str, DataFrame]) -> DataFrame:
    """(order_id, leakage_type, injected) of all planted events."""
    return reduce(
        DataFrame.unionByName,
        [
            ids.select("order_id", F.lit(kind).alias("leakage_type"), F.lit(True).alias("injected"))
            for kind, ids in targets.items()
        ],
    )


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("leakage_type").count().orderBy(F.desc("count"), "leakage_type")


def planting_targets(tables: Tables, category: str) -> dict[str, DataFrame]:
    """The chosen orders of all four kinds, from the clean tables."""
    return {
        L1: discount_targets(tables["order_payments"]),
        L2: refund_targets(tables["orders"], tables["order_items"], tables["products"], category),
        L3: churn_targets(tables["orders"], tables["order_payments"]),
        L4: lifecycle_targets(tables["order_items"]),
    }


def plant(tables: Tables, targets: dict[str, DataFrame]) -> Tables:
    """The tables with all four kinds of leakage planted: cancel, delete, then shorten."""
    orders = cancel_orders(tables["orders"], targets[L2])
    orders = delete_orders(orders, targets[L3])
    orders = shorten_lifecycles(orders, targets[L4])
    return {
        **tables,
        "orders": orders,
        "order_payments": scale_payments(tables["order_payments"], targets[L1]),
    }
