"""Datasets behind the executive and analyst views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from marginwatch.functions.labels import DISPLAY_NAMES, L1, L3, L4
from marginwatch.functions.money import cents, currency, mean, total

_NOTHING = "N/A"


def _largest(anomalies: DataFrame, key: str) -> DataFrame:
    """The key with the largest summed revenue gap, as one ``label`` row."""
    gaps = anomalies.groupBy(key).agg(F.sum(cents("revenue_gap")).alias("gap"))
    # Ties go to the first key in order.
    return gaps.orderBy(F.desc("gap"), key).limit(1).select(F.col(key).alias("label"))


def summary_kpis(totals: DataFrame, zscore: DataFrame) -> DataFrame:
    """Headline numbers in one row, from per-detector totals and z-score anomalies."""

    def risk(detector: str):
        return F.coalesce(F.max(F.when(F.col("detector") == detector, F.col("revenue_at_risk"))), F.lit(0.0))

    def largest(key: str):
        return F.coalesce(_largest(zscore, key).scalar(), F.lit(_NOTHING))

    return totals.agg(
        F.coalesce(total(cents("revenue_at_risk")), F.lit(0.0)).alias("total_risk"),
        F.coalesce(F.sum("flags"), F.lit(0)).alias("active_anomalies"),
        risk(L1).alias("l1_risk"),
        risk(L3).alias("l3_risk"),
        risk(L4).alias("l4_risk"),
    ).select(
        "total_risk",
        "active_anomalies",
        largest("category_en").alias("top_category"),
        largest("year_week").alias("worst_week"),
        "l1_risk",
        "l3_risk",
        "l4_risk",
    )


def kpi_cards(kpis: DataFrame) -> DataFrame:
    """Display texts of the headline numbers."""
    return kpis.select(
        currency("total_risk").alias("total_risk"),
        F.format_number("active_anomalies", 0).alias("active_anomalies"),
        F.substring("top_category", 1, 20).alias("top_category"),
        "worst_week",
    )


def revenue_with_average(monthly: DataFrame, months: int = 3) -> DataFrame:
    """Monthly revenue with its trailing mean; the input is one row per calendar month."""
    trailing = Window.orderBy("year_month").rowsBetween(1 - months, 0)
    value = cents("monthly_revenue")
    average = mean(F.sum(value).over(trailing), F.count(value).over(trailing))
    return monthly.select("year_month", "monthly_revenue", average.alias("rolling_avg")).orderBy("year_month")


def leakage_breakdown(totals: DataFrame) -> DataFrame:
    """Revenue at risk by leakage type, smallest first, with display text."""
    name = F.when(F.col("detector") == L1, f"{DISPLAY_NAMES[L1]} (L1)")
    name = name.when(F.col("detector") == L3, f"{DISPLAY_NAMES[L3]} (L3)")
    name = name.when(F.col("detector") == L4, f"{DISPLAY_NAMES[L4]} (L4)")
    return (
        totals.filter(F.col("detector").isin(L1, L3, L4))
        .select(
            name.alias("leakage_type"), "revenue_at_risk", currency("revenue_at_risk").alias("display_value")
        )
        .orderBy("revenue_at_risk", "leakage_type")
    )


def top_cancel_categories(top_categories: DataFrame, n: int = 5) -> DataFrame:
    """The highest cancellation rates among the top categories by revenue."""
    return (
        top_categories.orderBy(F.desc("cancel_rate_pct"), "category_en")
        .limit(n)
        .select(
            F.col("category_en").alias("Category"),
            currency("total_revenue").alias("Revenue (R$)"),
            F.col("orders_count").alias("Orders"),
            F.col("cancel_rate_pct").alias("Cancel Rate %"),
        )
    )


def detector_recall(scores: DataFrame) -> DataFrame:
    """Recall per detector in percent under its display name."""
    label = F.col("detector")
    for detector, shown in DISPLAY_NAMES.items():
        label = F.when(F.col("detector") == detector, shown).otherwise(label)
    return scores.select("detector", label.alias("label"), F.round(F.col("recall") * 100, 1).alias("recall_pct"))


def category_list(baseline: DataFrame) -> DataFrame:
    return baseline.select("category_en").filter(F.col("category_en").isNotNull()).distinct().orderBy("category_en")


def category_timeline(baseline: DataFrame, category: str | None = None) -> DataFrame:
    """One category's revenue, baseline, band and flags over time; the first one by default."""
    wanted = baseline.agg(F.min("category_en")).scalar() if category is None else F.lit(category)
    return (
        baseline.filter(F.col("category_en") == wanted)
        .select(
            "category_en",
            "year_week",
            "weekly_revenue",
            "rolling_mean",
            "upper_bound",
            "lower_bound",
            "is_anomaly",
        )
        .orderBy("year_week")
    )


def zscore_heatmap(baseline: DataFrame, categories: int = 15, weeks: int = 20) -> DataFrame:
    """Mean z-score of the largest categories over the last weeks that have one, in long form."""
    largest = (
        baseline.groupBy("category_en")
        .agg(F.sum(cents("weekly_revenue")).alias("revenue"))
        .orderBy(F.desc("revenue"), "category_en")
        .limit(categories)
        .select("category_en")
    )
    cells = (
        baseline.join(largest, "category_en", "left_semi")
        .filter(F.col("z_score").isNotNull())
        .groupBy("category_en", "year_week")
        .agg(F.avg("z_score").alias("z_score"))
    )
    last = cells.select("year_week").distinct().orderBy(F.desc("year_week")).limit(weeks)
    return cells.join(last, "year_week", "left_semi").select("category_en", "year_week", "z_score")


def heatmap_matrix(cells: DataFrame, weeks: Sequence[str]) -> DataFrame:
    """Heatmap cells as one row per category and one column per given week."""
    return cells.groupBy("category_en").pivot("year_week", list(weeks)).agg(F.first("z_score")).orderBy("category_en")


def zscore_heatmap_wide(cells: DataFrame, weeks: int = 20) -> DataFrame:
    """Heatmap cells as one row per category, with a column per week counted back from the last one.

    Pivoting on the rank needs no list of weeks. The window sees one row per week of the cells.
    """
    back = F.row_number().over(Window.orderBy(F.desc("year_week")))
    ranked = cells.select("year_week").distinct().withColumn("back", back)
    wide = cells.join(ranked, "year_week").groupBy("category_en").pivot("back", list(range(1, weeks + 1)))
    return wide.agg(F.first("z_score")).withColumnsRenamed({f"{k}": f"week_{k}" for k in range(1, weeks + 1)})


def rca_display(report: DataFrame) -> DataFrame:
    """The report's display columns, as far as present, with money as text."""
    wanted = [
        "year_week",
        "category",
        "revenue_gap",
        "z_score",
        "root_cause_state",
        "root_cause_seller",
        "seller_cancel_rate",
    ]
    shown = report.select(*[c for c in wanted if c in report.columns])
    return shown.withColumn("revenue_gap", currency("revenue_gap")) if "revenue_gap" in shown.columns else shown


def rca_choices(report: DataFrame) -> DataFrame:
    """One line of text per anomaly, for picking it, and the shortened seller id."""
    return report.select(
        F.concat_ws(
            " — ", "year_week", "category", F.concat(F.lit("Gap: "), currency("revenue_gap"))
        ).alias("choice"),
        F.concat(F.substring("root_cause_seller", 1, 12), F.lit("...")).alias("seller"),
    )


def dataset_stats(monthly: DataFrame, baseline: DataFrame, zscore: DataFrame) -> DataFrame:
    """Months covered, categories tracked and anomaly flags: one row."""
    return monthly.agg(F.count(F.lit(1)).alias("months")).select(
        "months",
        baseline.agg(F.count_distinct("category_en")).scalar().alias("categories"),
        zscore.agg(F.count_if("is_anomaly")).scalar().alias("anomaly_flags"),
    )
