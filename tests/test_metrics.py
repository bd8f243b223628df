from __future__ import annotations

import pandas as pd
import pytest

from marginwatch.operators import leakage, metrics, profiling, quality, trends


@pytest.fixture(scope="module")
def t(edge_tables):
    return edge_tables


@pytest.fixture(scope="module")
def fan(t):
    """The item x payment rows, joined literally."""
    orders, items, payments = (t[n].toPandas() for n in ("orders", "order_items", "order_payments"))
    named = t["products"].toPandas().merge(t["category_xlat"].toPandas(), on="product_category_name", how="left")
    named["category"] = named["product_category_name_english"].fillna(named["product_category_name"])
    payments = payments[payments.payment_value > 0]
    return orders.merge(payments, on="order_id").merge(items, on="order_id").merge(named, on="product_id")


def test_overall_kpis_count_payment_rows(t):
    row = metrics.overall_kpis(t["orders"], t["order_payments"]).first()
    # a 12.35 + 3, c, d, e, and the doubled order h twice
    assert row.total_orders == 6 and row.total_customers == 6
    assert row.net_revenue == pytest.approx(12.35 + 3 + 5.5 + 7.7 + 11 + 60 * 2)
    assert row.gmv == row.net_revenue and row.cancelled_revenue == 11.0
    assert row.avg_order_value == round(row.net_revenue / 7, 2)
    assert row.cancellation_rate_pct == 12.5


def test_distinct_counts_with_repeated_orders_and_null_customers(spark):
    rows = [("a", "x", "delivered"), ("a", "y", "delivered"), ("a", "x", "canceled"), ("b", None, "delivered")]
    orders = spark.createDataFrame(rows, "order_id string, customer_id string, order_status string")
    orders = orders.selectExpr("*", "timestamp_ntz'2018-01-05 00:00:00' AS order_purchase_timestamp")
    payments = spark.createDataFrame([("a", 2.0), ("b", 3.0)], "order_id string, payment_value double")
    row = metrics.overall_kpis(orders, payments).first()
    assert (row.total_orders, row.total_customers, row.gmv, row.cancelled_revenue) == (2, 2, 7.0, 2.0)
    month = metrics.monthly_revenue(orders, payments).first()
    assert (month.orders_count, month.unique_customers, month.monthly_revenue) == (2, 2, 7.0)
    none = metrics.overall_kpis(orders.limit(0), payments).first()
    assert (none.total_orders, none.total_customers, none.gmv, none.avg_order_value) == (0, 0, 0.0, None)


def test_full_weeks(spark):
    # 2018-01-14 is a Sunday, the last day of its week
    weekly = spark.createDataFrame([("2018-W01",), ("2018-W02",)], "year_week string")
    for day, weeks in (("2018-01-13", 1), ("2018-01-14", 2)):
        orders = spark.sql(f"SELECT timestamp_ntz'{day} 10:00:00' AS order_purchase_timestamp")
        assert trends.full_weeks(weekly, orders).count() == weeks


def test_months_skip_or_keep_null_time_as_defined(t):
    months = [r.year_month for r in metrics.monthly_revenue(t["orders"], t["order_payments"]).collect()]
    assert months == ["2018-01", "2018-02"]
    depth = metrics.discount_depth(t["orders"], t["order_items"], t["order_payments"]).collect()
    assert [r.year_month for r in depth] == [None, "2018-01", "2018-02"]
    refunds = {r.year_month: r for r in metrics.monthly_refund_rate(t["orders"]).collect()}
    assert refunds["2018-01"].total_orders == 5 and refunds["2018-01"].refund_rate_pct == 20.0


def test_discounts_follow_the_row_product_unless_deduped(t, fan):
    flags = leakage.discount_abuse(t["orders"], t["order_items"], t["order_payments"], -1000.0)
    got = {r.order_id: (r.list_price, r.actual_paid) for r in flags.collect()}
    done = fan[fan.order_status == "delivered"].assign(listed=lambda d: d.price + d.freight_value)
    want = done.groupby("order_id")[["listed", "payment_value"]].sum().round(2)
    assert got == {k: tuple(v) for k, v in zip(want.index, want.to_numpy())}
    once = leakage.discount_abuse(t["orders"], t["order_items"], t["order_payments"], -1000.0, dedupe=True)
    assert {r.order_id: r.actual_paid for r in once.collect()}["a"] == 15.35


def test_category_reports_match_the_literal_join(t, fan):
    args = (t["orders"], t["order_items"], t["order_payments"], t["products"], t["category_xlat"])
    got = {r.category_en: r for r in metrics.category_revenue(*args).collect()}
    want = fan.assign(category=fan.category.fillna("unknown")).groupby("category")
    assert set(got) == set(want.groups)
    for name, group in want:
        assert got[name].orders_count == group.order_id.nunique()
        assert got[name].total_revenue == pytest.approx(group.payment_value.sum())
        assert got[name].cancel_rate_pct == round(100 * (group.order_status == "canceled").mean(), 2)
    weeks = trends.category_weekly(*args).toPandas()
    dated = fan[fan.order_purchase_timestamp.notna()]
    assert weeks.weekly_revenue.sum() == pytest.approx(dated.payment_value.sum())
    assert set(weeks.year_week) == set(pd.to_datetime(dated.order_purchase_timestamp).dt.strftime("%Y-W%W"))
    geo = trends.geo_weekly(t["orders"], t["order_items"], t["order_payments"], t["sellers"]).toPandas()
    assert geo.weekly_revenue.sum() == pytest.approx(dated.payment_value.sum())


def test_weekly_change_starts_with_null(t):
    rows = trends.weekly_revenue(t["orders"], t["order_payments"]).collect()
    assert rows[0].prev_week_revenue is None and rows[0].wow_pct is None
    assert rows[1].wow_change == pytest.approx(rows[1].weekly_revenue - rows[0].weekly_revenue)


def test_customer_totals_and_tiers(t):
    totals = trends.customer_totals(t["orders"], t["order_payments"], t["customers"])
    got = {r.customer_unique_id: (r.total_orders, round(r.lifetime_value, 2)) for r in totals.collect()}
    assert got == {"u1": (2, 26.35), "u2": (1, 5.5), "u3": (2, 18.7), "u5": (1, 120.0)}
    tiers = trends.customer_tiers(totals)
    summary = trends.tier_summary(tiers).collect()
    assert sum(r.customer_count for r in summary) == 4
    assert [r.tier for r in summary] == ["High", "Mid", "Low"]


def test_near_zero_payments(t):
    assert metrics.near_zero_payments(t["order_payments"]).first().val == 0.0


def test_quality_report(t):
    report = quality.quality_report(t["orders"], t["order_items"], t["order_payments"]).collect()
    found = {(r.table, r.column, r.issue): (r.pct_affected, r.note) for r in report}
    delivery = "order_delivered_customer_date"
    assert found["orders", delivery, "nulls"] == (33.33, "33.3% of rows are null")
    assert found["orders", "order_purchase_timestamp", "nulls"][0] == 11.11
    assert found["orders", delivery, "logical inconsistency"][1].startswith("1 orders marked delivered")
    assert found["orders", delivery, "impossible date"] == (11.1111, "1 orders delivered before they were purchased")
    assert found["orders", "order_id", "duplicates"] == (11.1111, "1 duplicate order_ids found")
    assert found["order_payments", "payment_value", "zero value"][0] == 12.5
    assert found["order_items", "price", "zero or negative price"][0] == 12.5
    assert ("orders", "order_id", "nulls") not in found


def test_profile(t):
    rows = profiling.profile_tables({"orders": t["orders"], "products": t["products"]}).collect()
    nulls = {(r.table_name, r.column_name): r.null_count for r in rows}
    assert nulls["products", "product_category_name"] == 1 and nulls["orders", "order_purchase_timestamp"] == 1
    assert {r.row_count for r in rows if r.table_name == "orders"} == {9}
    assert profiling.preview(t["orders"]).count() == 2


def test_one_order_with_a_third_of_all_rows(spark, t):
    """A hot order, product and customer: totals come from row counts, not from row pairs."""
    items = spark.range(30000).selectExpr(
        "IF(id % 3 = 0, 'hot', CAST(id AS STRING)) AS order_id", "'p1' AS product_id", "'s1' AS seller_id",
        "1.0D AS price", "0.5D AS freight_value",
    )
    payments = spark.range(30000).selectExpr("IF(id % 3 = 0, 'hot', CAST(id AS STRING)) AS order_id", "2.0D AS payment_value")
    orders = items.select("order_id").distinct().selectExpr(
        "order_id", "'hot' AS customer_id", "'delivered' AS order_status",
        "TIMESTAMP_NTZ '2018-01-01 00:00:00' AS order_purchase_timestamp",
        "TIMESTAMP_NTZ '2018-01-05 00:00:00' AS order_delivered_customer_date",
    )
    (row,) = trends.category_weekly(orders, items, payments, t["products"], t["category_xlat"]).collect()
    assert row.orders_count == 20001
    assert row.weekly_revenue == 2.0 * (10000 * 10000 + 20000)
    lines = leakage.lifecycle_lines(orders, items, payments, t["products"], t["category_xlat"])
    flags = leakage.short_lifecycle_flags(lines).selectExpr("sum(flag_rows) AS n").first()
    assert flags.n == 10000 * 10000 + 20000
