"""Registered queries against their SQL in another engine, over whole tables."""

from __future__ import annotations

import pytest
from compare import difference, duck

import __spark_entry__ as entry
from marginwatch.plans import oracle, registry

BASE = "/root/testdata/sf0.001"
# One query per family; ``python tests/compare.py sf0.01`` runs them all.
CHOSEN = (
    "profile_tables dq_report overall_kpis monthly_revenue monthly_refund_rate discount_depth top_categories "
    "weekly_revenue_wow category_weekly geo_weekly customer_ltv_tier tier_summary rolling_baseline anomaly_summary "
    "zscore_anomalies iforest_scores l1_discount_20 l2_refund_spike l3_churn_90 l4_short_orders l4_short_flags "
    "l4_seller_category perturb_labels truth_category_weeks scorecard rca_report exec_kpis zscore_heatmap "
    "table_preview sql_parameterised monthly_revenue_dated category_weekly_deduped rolling_baseline_full_weeks "
    "zscore_heatmap_wide customer_ltv_rank tier_summary_ranked"
).split()


@pytest.fixture(scope="module")
def con():
    return duck(BASE)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(oracle.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["overall_kpis", "monthly_revenue"])
def test_distinct_counts_do_not_multiply_rows(spark, name):
    assert "Expand" not in entry.queries()[name](spark, BASE)._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, BASE), con, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize(
    "name", ["overall_kpis", "category_weekly", "geo_weekly", "l1_discount_30", "l4_seller_category", "rca_tier"]
)
def test_plans_stay_distributed(spark, name):
    """No cross joins, no Python rows, and scans that read only what they need."""
    plan = entry.queries()[name](spark, BASE)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "l_returnflag", "o_totalprice"):
        assert bad not in plan
