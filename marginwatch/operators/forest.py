"""Isolation forest per category (Liu, Ting and Zhou, 2008).

Rows are category weeks, so a category never holds more rows than the calendar has
weeks, whatever share of the orders it has. Categories and blocks of trees are spread
over the tasks; the trees of one block grow together in NumPy, a level at a time.
Draws come from the category's name, so scores repeat under any partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from marginwatch.functions.draws import digest, draw
from marginwatch.functions.isolation import EULER_GAMMA, isolation_depths, mix
from marginwatch.operators.baseline import history, rolling
from marginwatch.operators.quantile import quantile_scalars
from marginwatch.rules import RULES

FEATURES = (
    "weekly_revenue",
    "revenue_vs_baseline",
    "cancellation_rate",
    "avg_order_value",
    "z_score",
    "orders_count",
)
_TREES_PER_BLOCK = 10
_TREE_STRIDE = 104729
_NANO = 10**9


def forest_features(
    baseline: DataFrame, weeks: int = RULES.window_weeks, min_weeks: int = RULES.min_weeks
) -> DataFrame:
    """Baseline rows with ratio features; unknown ratios become neutral values."""
    orders = F.col("orders_count")
    usual_orders = rolling(orders, F.avg(orders).over(history(weeks)), history(weeks), min_weeks)
    (median_value,) = quantile_scalars(baseline, "avg_order_value", [0.5])
    return baseline.withColumns(
        {
            "cancellation_rate": F.coalesce(F.try_divide("cancellations", "orders_count"), F.lit(0.0)),
            "revenue_vs_baseline": F.coalesce(F.try_divide("weekly_revenue", "rolling_mean"), F.lit(1.0)),
            "orders_vs_baseline": F.coalesce(F.try_divide(orders, usual_orders), F.lit(1.0)),
            "z_score": F.coalesce("z_score", F.lit(0.0)),
            "avg_order_value": F.coalesce(F.col("avg_order_value"), median_value),
        }
    )


def standardise(features: DataFrame, min_weeks: int = RULES.min_category_weeks) -> DataFrame:
    """Features of categories with enough weeks, scaled to mean 0 and deviation 1 per category.

    A constant feature is only centred. Adds ``f0`` to ``f5`` in feature order and ``n``,
    the category's weeks.
    """
    category = Window.partitionBy("category_en")
    scaled = {}
    for i, name in enumerate(FEATURES):
        value = F.col(name).cast("double")
        spread = F.stddev_pop(value).over(category)
        scaled[f"f{i}"] = (value - F.avg(value).over(category)) / F.when(spread == 0, 1.0).otherwise(spread)
    counted = features.withColumn("n", F.count(F.lit(1)).over(category)).filter(F.col("n") >= min_weeks)
    return counted.withColumns(scaled)


def expected_depth(rows: Column) -> Column:
    """Mean path length of an unsuccessful search among ``rows`` > 2 values."""
    return 2.0 * (F.ln(rows - 1) + EULER_GAMMA) - 2.0 * (rows - 1) / rows


def forest_depths(
    scaled: DataFrame,
    trees: int = RULES.trees,
    sample_size: int = RULES.sample_size,
    seed: int = RULES.seed,
) -> DataFrame:
    """Mean isolation depth per category week over all trees.

    Depths are summed as whole nanos, so the mean does not depend on summation order.
    """
    values = [f"f{i}" for i in range(len(FEATURES))]

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("year_week")
        first = int(group["block"].iloc[0]) * _TREES_PER_BLOCK
        numbers = np.arange(first, min(first + _TREES_PER_BLOCK, trees), dtype=np.int64)
        seeds = mix(int(group["seed"].iloc[0]) + numbers * _TREE_STRIDE + 1)
        depths = isolation_depths(group[values].to_numpy(dtype=float), seeds, sample_size)
        nanos = np.rint(depths * _NANO).astype(np.int64).sum(axis=0)
        return group[["category_en", "year_week"]].assign(nanos=nanos)

    blocks = F.sequence(F.lit(0), F.lit((trees - 1) // _TREES_PER_BLOCK))
    # Few bytes but much work per row: a fixed count keeps adaptive execution from
    # merging the groups into a handful of tasks.
    tasks = int(scaled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        scaled.select("category_en", "year_week", *values)
        .withColumns({"block": F.explode(blocks), "seed": draw(digest(f"forest{seed}", F.col("category_en")))})
        .repartition(tasks, "category_en", "block")
        .groupBy("category_en", "block")
        .applyInPandas(grow, "category_en string, year_week string, nanos long")
        .groupBy("category_en", "year_week")
        .agg((F.sum("nanos") / F.lit(float(trees * _NANO))).alias("depth"))
    )


def forest_scores(
    features: DataFrame,
    trees: int = RULES.trees,
    sample_size: int = RULES.sample_size,
    contamination: float = RULES.contamination,
    min_weeks: int = RULES.min_category_weeks,
    seed: int = RULES.seed,
    zscore_below: float = RULES.zscore_below,
) -> DataFrame:
    """Feature rows of long enough categories with forest score, prediction and agreement.

    More negative scores are odder. The oddest ``contamination`` share of a category is
    predicted -1, and a week also below the z-score threshold is flagged by both.
    """
    scaled = standardise(features, min_weeks)
    depths = forest_depths(scaled, trees, sample_size, seed)
    usual = expected_depth(F.least(F.col("n"), F.lit(sample_size)))
    score = F.round(-F.pow(F.lit(2.0), -F.col("depth") / usual), 10)
    cutoff = F.percentile(F.col("if_score"), F.lit(contamination)).over(Window.partitionBy("category_en"))
    kept = scaled.drop(*[f"f{i}" for i in range(len(FEATURES))])
    return (
        kept.join(depths, ["category_en", "year_week"])
        .withColumn("if_score", score)
        .withColumn("if_prediction", F.when(F.col("if_score") < cutoff, -1).otherwise(1))
        .withColumn("if_anomaly", F.col("if_prediction") == -1)
        .withColumn("flagged_by_zscore", F.col("z_score") < zscore_below)
        .withColumn("flagged_by_both", F.col("if_anomaly") & F.col("flagged_by_zscore"))
        .drop("n", "depth")
    )


def high_confidence(scores: DataFrame) -> DataFrame:
    return scores.filter("flagged_by_both")


def detector_overlap(scores: DataFrame) -> DataFrame:
    """Categories analysed and flags per detector, alone and together."""
    return scores.agg(
        F.count_distinct("category_en").alias("categories"),
        F.count_if("if_anomaly").alias("forest_flags"),
        F.count_if("flagged_by_zscore").alias("zscore_flags"),
        F.count_if("flagged_by_both").alias("both_flags"),
    )


def forest_top(scores: DataFrame, n: int = 10) -> DataFrame:
    """The oddest flagged weeks."""
    return (
        scores.filter("if_anomaly")
        .select(
            "year_week",
            "category_en",
            "weekly_revenue",
            "revenue_vs_baseline",
            "cancellation_rate",
            "if_score",
            "flagged_by_both",
        )
        .orderBy("if_score", "category_en", "year_week")
        .limit(n)
    )
