"""The registered queries: name -> (spark, star directory) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marginwatch.functions.labels import L1
from marginwatch.functions.timekeys import month_start
from marginwatch.operators import (
    baseline as bl,
    forest as fo,
    leakage as lk,
    metrics as me,
    perturb as px,
    profiling as pf,
    reporting as rp,
    trends as tr,
)
from marginwatch.plans.analysis import Analysis, Trial
from marginwatch.sources.files import register_tables, run_query
from marginwatch.sources.star import star_tables

Query = Callable[[SparkSession, str], DataFrame]

# The category whose orders the planted refund spike cancels.
SPIKE_CATEGORY = "Brand#11"


def _analysis(result: Callable[[Analysis], DataFrame]) -> Query:
    return lambda spark, base: result(Analysis(star_tables(spark, base)))


def _shared(result: Callable[[Analysis], DataFrame]) -> Query:
    """For results that need several others."""
    return lambda spark, base: result(Analysis(star_tables(spark, base), shared=True))


def _tables(result: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    return lambda spark, base: result(star_tables(spark, base))


def _trial(result: Callable[[Trial], DataFrame]) -> Query:
    return lambda spark, base: result(Trial(star_tables(spark, base), SPIKE_CATEGORY))


def _scorecard(result: Callable[[Trial], DataFrame]) -> Query:
    return _trial(lambda t: result(t.share()))


def _orders_by_status(spark: SparkSession, base: str) -> DataFrame:
    """SQL text with parameters over registered views."""
    register_tables({"orders": star_tables(spark, base)["orders"]}, "marginwatch_")
    return run_query(
        spark,
        """SELECT order_status, COUNT(*) AS orders_count FROM marginwatch_orders
        WHERE order_purchase_timestamp >= CAST(:since AS TIMESTAMP)
          AND order_purchase_timestamp < CAST(:until AS TIMESTAMP) GROUP BY order_status""",
        {"since": "1995-01-01", "until": "1997-01-01"},
    )


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Unrounded statistics to a fixed number of digits, for comparison across engines."""

    def rounded(c: str) -> Column:
        return F.round(F.col(c), digits)

    return df.withColumns({c: rounded(c) for c in columns})


def _features(a: Analysis) -> DataFrame:
    return _rounded(a.forest_features, 6, "cancellation_rate", "revenue_vs_baseline", "orders_vs_baseline")


def _scores(df: DataFrame) -> DataFrame:
    return _rounded(
        df, 6, "cancellation_rate", "revenue_vs_baseline", "orders_vs_baseline", "if_score"
    )


def _standardised(a: Analysis) -> DataFrame:
    names = [f"f{i}" for i in range(len(fo.FEATURES))]
    return _rounded(fo.standardise(a.forest_features), 6, *names).select("category_en", "year_week", "n", *names)


def _spikes(df: DataFrame) -> DataFrame:
    return _rounded(df, 6, "rolling_cancel_mean", "rolling_cancel_std", "cancel_z_score")


def queries() -> dict[str, Query]:
    return {
        # profile and quality
        "profile_tables": _tables(pf.profile_tables),
        "table_preview": _tables(
            lambda t: pf.first_rows(t["orders"].select("order_id", "customer_id", "order_status"), 2, "order_id")
        ),
        "sql_parameterised": _orders_by_status,
        "dq_report": _analysis(lambda a: a.dq_report),
        # revenue KPIs
        "overall_kpis": _analysis(lambda a: a.overall_kpis),
        "monthly_revenue": _analysis(lambda a: a.monthly_revenue),
        "monthly_revenue_dated": _analysis(
            lambda a: a.monthly_revenue.withColumn("year_month", month_start("year_month"))
        ),
        "monthly_refund_rate": _analysis(lambda a: a.monthly_refund_rate),
        "discount_depth": _analysis(lambda a: a.discount_depth),
        "discount_depth_deduped": _analysis(
            lambda a: me.discount_depth(a.orders, a.items, a.payments, dedupe=True)
        ),
        "top_categories": _analysis(lambda a: a.top_categories),
        "near_zero_payments": _tables(lambda t: me.near_zero_payments(t["order_payments"])),
        # segment trends
        "weekly_revenue_wow": _analysis(lambda a: a.weekly_revenue),
        "weekly_tail": _analysis(lambda a: pf.last_rows(a.weekly_revenue, 10, "year_week")),
        "category_weekly": _analysis(lambda a: a.category_weekly),
        "category_weekly_head": _analysis(
            lambda a: pf.first_rows(a.category_weekly, 15, "year_week", F.desc("weekly_revenue"), "category_en")
        ),
        "category_weekly_deduped": _analysis(
            lambda a: tr.category_weekly(a.orders, a.items, a.payments, *a.catalog, dedupe=True)
        ),
        "geo_weekly": _analysis(lambda a: a.geo_weekly),
        "customer_ltv_tier": _analysis(lambda a: a.customer_tiers),
        "customer_ltv_rank": _analysis(lambda a: _rounded(a.ranked_customers, 9, "percent_rank")),
        "tier_summary_ranked": _analysis(lambda a: tr.tier_summary(a.ranked_customers)),
        "tier_summary": _analysis(lambda a: a.tier_summary),
        # baseline and anomalies
        "rolling_baseline": _analysis(lambda a: a.baseline),
        "rolling_baseline_full_weeks": _analysis(lambda a: a.full_weeks_baseline),
        "anomaly_summary": _analysis(lambda a: a.anomaly_summary),
        "zscore_anomalies": _analysis(lambda a: a.zscore),
        "zscore_summary": _analysis(lambda a: bl.zscore_summary(a.zscore)),
        "zscore_severity": _analysis(lambda a: bl.zscore_by_severity(a.zscore)),
        "zscore_top": _analysis(lambda a: bl.zscore_top(a.zscore)),
        "iforest_features": _analysis(_features),
        "iforest_standardised": _analysis(_standardised),
        "iforest_scores": _analysis(lambda a: _scores(a.forest_scores)),
        "iforest_overlap": _analysis(lambda a: fo.detector_overlap(a.forest_scores)),
        "iforest_top": _analysis(
            lambda a: _rounded(
                fo.forest_top(a.forest_scores), 6, "revenue_vs_baseline", "cancellation_rate", "if_score"
            )
        ),
        "high_confidence": _analysis(lambda a: _scores(a.high_confidence)),
        # leakage detectors
        "l1_discount_20": _analysis(lambda a: lk.as_detections(a.l1_first, L1)),
        "l1_discount_30": _analysis(lambda a: a.l1),
        "l2_refund_rates": _analysis(lambda a: lk.refund_rates(a.orders, a.items, *a.catalog)),
        "l2_refund_spike": _analysis(lambda a: _spikes(a.l2)),
        "l3_churn_180": _analysis(lambda a: a.l3_first),
        "l3_churn_90": _analysis(lambda a: a.l3),
        "l4_short_orders": _analysis(lambda a: a.l4),
        "l4_short_flags": _analysis(lambda a: a.l4_flags),
        "l4_seller_category": _analysis(lambda a: a.l4_sellers),
        "detector_totals": _shared(lambda a: a.detector_totals),
        "revenue_at_risk": _shared(lambda a: lk.revenue_at_risk(a.detector_totals)),
        # planted leakage
        "l1_scaled_payments": _tables(
            lambda t: px.scale_payments(t["order_payments"], px.discount_targets(t["order_payments"]))
        ),
        "l2_cancelled_orders": _tables(
            lambda t: px.cancel_orders(
                t["orders"],
                px.refund_targets(t["orders"], t["order_items"], t["products"], SPIKE_CATEGORY),
            )
        ),
        "l3_deleted_orders": _tables(
            lambda t: px.delete_orders(t["orders"], px.churn_targets(t["orders"], t["order_payments"]))
        ),
        "l4_shortened_orders": _tables(
            lambda t: px.shorten_lifecycles(t["orders"], px.lifecycle_targets(t["order_items"]))
        ),
        "perturb_labels": _trial(lambda t: t.labels),
        "perturb_label_counts": _trial(lambda t: px.label_counts(t.labels)),
        # evaluation on the planted tables
        "truth_category_weeks": _trial(lambda t: t.truth),
        "eval_zscore": _trial(lambda t: t.eval_zscore),
        "eval_iforest": _trial(lambda t: t.eval_forest),
        "eval_l1": _trial(lambda t: t.eval_l1()),
        "eval_l2": _trial(lambda t: t.eval_l2()),
        "eval_l3": _trial(lambda t: t.eval_l3()),
        "eval_l4": _trial(lambda t: t.eval_l4()),
        "eval_l4_sellers": _trial(lambda t: t.eval_l4(tuned=False)),
        "scorecard": _scorecard(lambda t: t.scorecard()),
        "scorecard_first": _scorecard(lambda t: t.scorecard(tuned=False)),
        # root causes
        "rca_targets": _analysis(lambda a: a.rca_targets),
        "rca_state": _shared(lambda a: a.rca_state),
        "rca_seller": _shared(lambda a: a.rca_seller),
        "rca_tier": _shared(lambda a: a.rca_tier),
        "rca_report": _shared(lambda a: a.rca_report),
        # reporting datasets
        "exec_kpis": _shared(lambda a: a.summary_kpis),
        "kpi_cards": _shared(lambda a: rp.kpi_cards(a.summary_kpis)),
        "revenue_3mo_avg": _analysis(lambda a: rp.revenue_with_average(a.monthly_revenue)),
        "leakage_breakdown": _shared(lambda a: rp.leakage_breakdown(a.detector_totals)),
        "top5_cancel": _analysis(lambda a: rp.top_cancel_categories(a.top_categories)),
        "detector_recall": _scorecard(lambda t: rp.detector_recall(t.scorecard())),
        "category_list": _analysis(lambda a: rp.category_list(a.baseline)),
        "category_timeline": _analysis(lambda a: rp.category_timeline(a.staged_baseline)),
        "zscore_heatmap": _analysis(lambda a: rp.zscore_heatmap(a.staged_baseline)),
        "zscore_heatmap_wide": _analysis(lambda a: rp.zscore_heatmap_wide(rp.zscore_heatmap(a.staged_baseline))),
        "rca_display": _shared(lambda a: rp.rca_display(a.rca_report)),
        "rca_choices": _shared(lambda a: rp.rca_choices(a.rca_report)),
        "dataset_stats": _shared(lambda a: a.dataset_stats),
    }
