"""Rolling revenue baseline per category and the z-score detector on top of it.

The windows run over one row per category and week, so a partition is never longer
than the calendar, whatever share of the orders its category holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from marginwatch.functions.labels import severity
from marginwatch.functions.money import amount, cents, clip_low, mean, percent, total
from marginwatch.rules import RULES


def history(weeks: int) -> WindowSpec:
    """The ``weeks`` rows before the current one in a category; missing weeks are not filled."""
    return Window.partitionBy("category_en").orderBy("year_week").rowsBetween(-weeks, -1)


def rolling(value: Column, measure: Column, window: WindowSpec, min_weeks: int) -> Column:
    """``measure`` over the window where it holds at least ``min_weeks`` values."""
    return F.when(F.count(value).over(window) >= min_weeks, measure)


def rolling_mean(value: Column, window: WindowSpec, min_weeks: int) -> Column:
    """Mean of a two-decimal column, not rounded."""
    hundredths = cents(value)
    sums, counts = F.sum(hundredths).over(window), F.count(hundredths).over(window)
    return rolling(value, sums / (counts * 100), window, min_weeks)


def rolling_median(value: Column, window: WindowSpec, min_weeks: int) -> Column:
    """Median of a two-decimal column, rounded to cents; halves of a cent are exact in cents."""
    middle = F.percentile(cents(value), F.lit(0.5)).over(window)
    return rolling(value, amount(F.round(middle)), window, min_weeks)


def rolling_baseline(
    weekly: DataFrame,
    weeks: int = RULES.window_weeks,
    min_weeks: int = RULES.min_weeks,
    sigmas: float = RULES.band_sigmas,
) -> DataFrame:
    """Expected band, z-score, anomaly flag and revenue at risk for every category week.

    Everything is computed unrounded and rounded at the end; later steps see the
    rounded values.
    """
    window = history(weeks)
    revenue = F.col("weekly_revenue")
    usual, deviation = F.col("usual"), F.col("deviation")
    in_cents = cents(revenue)
    return (
        weekly.withColumns(
            {
                "usual": rolling_mean(revenue, window, min_weeks),
                "rolling_mean": rolling(
                    revenue,
                    mean(F.sum(in_cents).over(window), F.count(in_cents).over(window)),
                    window,
                    min_weeks,
                ),
                "deviation": rolling(revenue, F.stddev_samp(revenue).over(window), window, min_weeks),
                "rolling_median": rolling_median(revenue, window, min_weeks),
            }
        )
        .withColumns({"upper": usual + sigmas * deviation, "lower": clip_low(usual - sigmas * deviation)})
        .select(
            "year_week",
            "category_en",
            "orders_count",
            "weekly_revenue",
            "avg_order_value",
            "cancellations",
            "rolling_mean",
            F.round("deviation", 2).alias("rolling_std"),
            "rolling_median",
            F.round("upper", 2).alias("upper_bound"),
            F.round("lower", 2).alias("lower_bound"),
            F.round((revenue - usual) / F.nullif(deviation, F.lit(0.0)), 2).alias("z_score"),
            F.coalesce((revenue < F.col("lower")) | (revenue > F.col("upper")), F.lit(False)).alias("is_anomaly"),
            F.round(clip_low(F.col("lower") - revenue), 2).alias("revenue_at_risk"),
        )
    )


def anomaly_summary(baseline: DataFrame, n: int = 15) -> DataFrame:
    """The categories with the most revenue at risk among their anomalous weeks."""
    z = cents("z_score")
    return (
        baseline.filter("is_anomaly")
        .groupBy("category_en")
        .agg(
            F.count(F.lit(1)).alias("anomaly_weeks"),
            total(cents("revenue_at_risk")).alias("total_at_risk"),
            mean(F.sum(z), F.count(z)).alias("avg_z_score"),
        )
        .orderBy(F.desc("total_at_risk"), "category_en")
        .limit(n)
    )


def zscore_anomalies(
    baseline: DataFrame,
    below: float = RULES.zscore_below,
    min_expected: float = RULES.min_expected_revenue,
) -> DataFrame:
    """Category weeks far below a baseline large enough to matter."""
    expected, actual = cents("rolling_mean"), cents("weekly_revenue")
    return baseline.filter((F.col("z_score") < below) & (F.col("rolling_mean") >= min_expected)).withColumns(
        {
            "severity": severity(F.col("z_score")),
            "expected_revenue": F.col("rolling_mean"),
            "actual_revenue": F.col("weekly_revenue"),
            "revenue_gap": amount(expected - actual),
            "revenue_gap_pct": percent(expected - actual, expected, 1),
        }
    )


def zscore_summary(anomalies: DataFrame) -> DataFrame:
    return anomalies.agg(
        F.count(F.lit(1)).alias("flags"),
        F.count_distinct("category_en").alias("categories"),
        F.coalesce(total(cents("revenue_gap")), F.lit(0.0)).alias("total_gap"),
    )


def zscore_by_severity(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("severity").count().orderBy(F.desc("count"), "severity")


def zscore_top(anomalies: DataFrame, n: int = 10) -> DataFrame:
    return (
        anomalies.select(
            "year_week",
            "category_en",
            "actual_revenue",
            "expected_revenue",
            "revenue_gap",
            "z_score",
            "severity",
        )
        .orderBy(F.desc("revenue_gap"), "category_en", "year_week")
        .limit(n)
    )
