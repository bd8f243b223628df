"""Scoring detectors against labelled events."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from marginwatch.functions.labels import L1, L2, L3, L4
from marginwatch.functions.timekeys import year_week
from marginwatch.operators.facts import product_categories

PURCHASED = "order_purchase_timestamp"


def labels_of(labels: DataFrame, leakage_type: str) -> DataFrame:
    return labels.filter(F.col("leakage_type") == leakage_type).select("order_id").distinct()


def resolve_labels(labels: DataFrame, raw_orders: DataFrame) -> DataFrame:
    """Labels with the customer record and time of their orders, before any deletion.

    Stage the result: its file size then tells the planner whether it can be broadcast
    to the large tables, which a join's estimate does not.
    """
    return labels.select("order_id", "leakage_type").join(
        raw_orders.select("order_id", "customer_id", PURCHASED), "order_id"
    )


def truth_category_weeks(
    resolved: DataFrame, items: DataFrame, products: DataFrame, category_xlat: DataFrame
) -> DataFrame:
    """Labelled item rows per week, category and leakage type.

    Categories are translated, so that the keys are comparable with the detectors' keys.
    Labels without a week or a category drop out, so all joins are inner ones.
    """
    return (
        resolved.filter(F.col(PURCHASED).isNotNull())
        .select("order_id", "leakage_type", year_week(PURCHASED).alias("year_week"))
        .join(items.select("order_id", "product_id"), "order_id")
        .join(product_categories(products, category_xlat), "product_id")
        .groupBy("year_week", "category_en", "leakage_type")
        .agg(F.count(F.lit(1)).alias("injected_count"))
    )


def _rate(hits: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(hits.cast("double"), of), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def marked(
    flagged: DataFrame,
    truth: DataFrame,
    keys: Sequence[str],
    detector: str,
    count_rows: bool = False,
    flag_rows: DataFrame | None = None,
) -> DataFrame:
    """(detector, key, flag, real, counted): a detector's flags and labels, to be judged together with others.

    The reported flags are the distinct flagged keys, with ``count_rows`` the flagged rows, or the
    rows of ``flag_rows``; ``counted`` marks the rows that count as such, or is null.
    """
    key = F.col(keys[0]).cast("string") if len(keys) == 1 else F.to_json(F.struct(*keys))
    none = F.lit(None).cast("int")
    sides = [
        flagged.select(key.alias("key"), F.lit(1).alias("flag"), F.lit(0).alias("real"), (F.lit(1) if count_rows else none).alias("counted")),
        truth.select(key.alias("key"), F.lit(0).alias("flag"), F.lit(1).alias("real"), none.alias("counted")),
    ]
    # a row without a key: the detector is listed even without flags and labels, and no rows count 0
    by_rows = count_rows or flag_rows is not None
    extra = [flagged.sparkSession.range(0, 1, 1, 1).select((F.lit(0) if by_rows else none).alias("counted"))]
    if flag_rows is not None:
        extra.append(flag_rows.select(F.lit(1).alias("counted")))
    for rows in extra:
        empty = (F.lit(None).cast("string").alias("key"), F.lit(0).alias("flag"), F.lit(0).alias("real"))
        sides.append(rows.select(*empty, "counted"))
    return reduce(DataFrame.unionByName, sides).withColumn("detector", F.lit(detector))


def judge(stacked: DataFrame, f1_of_rounded: bool = False) -> DataFrame:
    """Flags, hits, misses, precision, recall and F1 over distinct keys: one row per detector.

    All detectors' flags and labels lie in one table and are grouped once, so a key's copies collapse
    before the shuffle and no detector needs a plan of its own.
    """
    sets = stacked.groupBy("detector", "key").agg(
        F.max("flag").alias("flag"), F.max("real").alias("real"), F.sum("counted").alias("counted")
    )
    counts = sets.groupBy("detector").agg(
        F.count_if(F.col("flag") == 1).alias("keys"),
        F.count_if((F.col("flag") == 1) & (F.col("real") == 1)).alias("tp"),
        F.count_if((F.col("flag") == 1) & (F.col("real") == 0)).alias("fp"),
        F.count_if((F.col("flag") == 0) & (F.col("real") == 1)).alias("fn"),
        F.sum("counted").alias("counted"),
    )
    precision, recall = _rate(F.col("tp"), F.col("keys")), _rate(F.col("tp"), F.col("tp") + F.col("fn"))
    rounded = (F.round(precision, 3), F.round(recall, 3))
    return counts.select(
        "detector",
        F.coalesce("counted", "keys").alias("flags"),
        F.col("tp").alias("true_positives"),
        F.col("fp").alias("false_positives"),
        F.col("fn").alias("false_negatives"),
        rounded[0].alias("precision"),
        rounded[1].alias("recall"),
        F.round(_f1(*(rounded if f1_of_rounded else (precision, recall))), 3).alias("f1"),
    )


def evaluate(
    flagged: DataFrame,
    truth: DataFrame,
    keys: Sequence[str],
    detector: str,
    count_rows: bool = False,
    flag_rows: DataFrame | None = None,
    f1_of_rounded: bool = False,
) -> DataFrame:
    """:func:`judge` for one detector: one row."""
    return judge(marked(flagged, truth, keys, detector, count_rows, flag_rows), f1_of_rounded)


def evaluate_category_weeks(flags: DataFrame, truth: DataFrame, detector: str) -> DataFrame:
    return evaluate(flags, truth, ["year_week", "category_en"], detector)


def discount_sets(flags: DataFrame, labels: DataFrame) -> dict:
    return {"flagged": flags, "truth": labels_of(labels, L1), "keys": ["order_id"], "detector": L1}


def refund_sets(spikes: DataFrame, labels: DataFrame, orders: DataFrame) -> dict:
    """Judged by week; labelled orders are looked up in the orders the detector saw."""
    dated = orders.filter(F.col(PURCHASED).isNotNull()).select("order_id", year_week(PURCHASED).alias("year_week"))
    weeks = dated.join(labels_of(labels, L2), "order_id", "left_semi")
    return {"flagged": spikes, "truth": weeks, "keys": ["year_week"], "detector": L2, "count_rows": True}


def churn_sets(churned: DataFrame, resolved: DataFrame, customers: DataFrame) -> dict:
    """Judged by person; the labelled orders are deleted ones, so they come resolved."""
    lost = resolved.filter(F.col("leakage_type") == L3).select("customer_id")
    people = lost.join(customers.select("customer_id", "customer_unique_id"), "customer_id")
    return {"flagged": churned, "truth": people, "keys": ["customer_unique_id"], "detector": L3}


def lifecycle_sets(flags: DataFrame, labels: DataFrame) -> dict:
    return {"flagged": flags, "truth": labels_of(labels, L4), "keys": ["order_id"], "detector": L4}


def lifecycle_seller_sets(sellers: DataFrame, short_lines: DataFrame, labels: DataFrame) -> dict:
    """Seller-category flags, judged on the short orders of exactly those pairs."""
    orders = short_lines.join(sellers.select("seller_id", "category_en"), ["seller_id", "category_en"], "left_semi")
    return {**lifecycle_sets(orders, labels), "flag_rows": sellers}


def evaluate_discount(flags: DataFrame, labels: DataFrame, f1_of_rounded: bool = False) -> DataFrame:
    return evaluate(**discount_sets(flags, labels), f1_of_rounded=f1_of_rounded)


def evaluate_refund(
    spikes: DataFrame, labels: DataFrame, orders: DataFrame, f1_of_rounded: bool = False
) -> DataFrame:
    return evaluate(**refund_sets(spikes, labels, orders), f1_of_rounded=f1_of_rounded)


def evaluate_churn(
    churned: DataFrame, resolved: DataFrame, customers: DataFrame, f1_of_rounded: bool = False
) -> DataFrame:
    return evaluate(**churn_sets(churned, resolved, customers), f1_of_rounded=f1_of_rounded)


def evaluate_lifecycle(flags: DataFrame, labels: DataFrame) -> DataFrame:
    return evaluate(**lifecycle_sets(flags, labels))


def evaluate_lifecycle_sellers(
    sellers: DataFrame, short_lines: DataFrame, labels: DataFrame, f1_of_rounded: bool = True
) -> DataFrame:
    return evaluate(**lifecycle_seller_sets(sellers, short_lines, labels), f1_of_rounded=f1_of_rounded)


def scorecard(detectors: Sequence[dict], f1_of_rounded: bool = False) -> DataFrame:
    """All detectors judged in one pass; each is given as the sets that :func:`marked` takes."""
    stacked = reduce(DataFrame.unionByName, [marked(**sets) for sets in detectors])
    return judge(stacked, f1_of_rounded).orderBy("detector")
