from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marginwatch.functions.labels import L1, L2, L3, L4
from marginwatch.operators import evaluation as ev, facts, perturb as px, reporting as rp, root_cause as rc


def _keys(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "order_id string")


def test_scores_use_distinct_keys(spark):
    row = ev.evaluate(_keys(spark, "a", "a", "b", "c"), _keys(spark, "b", "d", "d"), ["order_id"], "x").first()
    assert (row.flags, row.true_positives, row.false_positives, row.false_negatives) == (3, 1, 2, 1)
    assert (row.precision, row.recall, row.f1) == (0.333, 0.5, 0.4)


@pytest.mark.parametrize("flags,truth,want", [((), (), (0, 0, 0)), (("a",), (), (0, 1, 0)), ((), ("a",), (0, 0, 1))])
def test_scores_guard_zero(spark, flags, truth, want):
    row = ev.evaluate(_keys(spark, *flags), _keys(spark, *truth), ["order_id"], "x").first()
    assert (row.true_positives, row.false_positives, row.false_negatives) == want
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)


def test_flags_may_be_counted_at_another_grain(spark):
    flags = _keys(spark, "a", "a", "b")
    assert ev.evaluate(flags, _keys(spark, "a"), ["order_id"], "x", count_rows=True).first().flags == 3
    assert ev.evaluate(flags, _keys(spark, "a"), ["order_id"], "x", flag_rows=flags.limit(1)).first().flags == 1


def test_f1_of_rounded_scores(spark):
    flags, truth = _keys(spark, *map(str, range(7))), _keys(spark, *map(str, range(6, 17)))
    exact = ev.evaluate(flags, truth, ["order_id"], "x").first()
    rounded = ev.evaluate(flags, truth, ["order_id"], "x", f1_of_rounded=True).first()
    assert exact.f1 == round(2 / 18, 3)
    p, r = exact.precision, exact.recall
    assert rounded.f1 == round(2 * p * r / (p + r), 3)


def test_truth_translates_and_drops_unresolved(spark, edge_tables):
    t = edge_tables
    labels = spark.createDataFrame([("a", L1), ("c", L1), ("e", L1), ("g", L3)], "order_id string, leakage_type string")
    resolved = ev.resolve_labels(labels, t["orders"])
    truth = ev.truth_category_weeks(resolved, t["order_items"], t["products"], t["category_xlat"]).collect()
    assert {(r.year_week, r.category_en) for r in truth} == {
        ("2018-W01", "toys"),
        ("2018-W01", "untranslated"),
        ("2018-W02", "unknown"),
    }


@pytest.fixture(scope="module")
def shop(spark):
    """400 orders of 40 records with two sellers' worth of skew, over a year."""
    base = spark.range(400)
    orders = base.selectExpr(
        "CAST(id AS STRING) AS order_id", "CONCAT('r', id % 40) AS customer_id", "'delivered' AS order_status",
        "TIMESTAMP_NTZ '2018-01-01 00:00:00' + make_dt_interval(CAST(id % 365 AS INT)) AS order_purchase_timestamp",
        "TIMESTAMP_NTZ '2018-03-01 00:00:00' + make_dt_interval(CAST(id % 365 AS INT)) AS order_delivered_customer_date",
    )
    items = base.selectExpr(
        "CAST(id AS STRING) AS order_id", "CONCAT('p', id % 4) AS product_id", "CONCAT('s', id % 7) AS seller_id",
        "10.0D AS price", "1.0D AS freight_value",
    )
    payments = base.selectExpr("CAST(id AS STRING) AS order_id", "CAST(5 + id % 40 AS DOUBLE) AS payment_value")
    products = spark.createDataFrame([(f"p{i}", f"c{i}") for i in range(4)], "product_id string, product_category_name string")
    return {"orders": orders, "order_items": items, "order_payments": payments, "products": products}


def test_planting_is_repeatable_and_labelled(spark, shop):
    targets = px.planting_targets(shop, "c1")
    again = px.planting_targets({k: v.repartition(5) for k, v in shop.items()}, "c1")
    ids = {kind: {r.order_id for r in df.collect()} for kind, df in targets.items()}
    assert ids == {kind: {r.order_id for r in df.collect()} for kind, df in again.items()}
    assert len(ids[L1]) == 200 and 0 < len(ids[L2]) <= 150 and 0 < len(ids[L4]) <= 100
    assert all(int(i) % 4 == 1 for i in ids[L2])
    # 400 orders over 7 sellers: the first has 58, the sixth in order of (count, id) is s5
    assert all(int(i) % 7 == 5 for i in ids[L4])
    counts = {r.leakage_type: r["count"] for r in px.label_counts(px.labels_table(targets)).collect()}
    assert counts == {kind: len(found) for kind, found in ids.items()}

    planted = px.plant(shop, targets)
    before = {r.order_id: r.payment_value for r in shop["order_payments"].collect()}
    for r in planted["order_payments"].collect():
        share = r.payment_value / before[r.order_id]
        assert (0.39 < share < 0.61) if r.order_id in ids[L1] else share == 1.0
    orders = {r.order_id: r for r in planted["orders"].collect()}
    assert set(orders) == set(before) - ids[L3]
    assert {i for i, r in orders.items() if r.order_status == "canceled"} == ids[L2] - ids[L3]
    for i in ids[L4] - ids[L3]:
        assert (orders[i].order_delivered_customer_date - orders[i].order_purchase_timestamp).days == 15


def test_deleted_orders_are_recent_and_of_the_best_records(shop):
    chosen = {int(r.order_id) for r in px.churn_targets(shop["orders"], shop["order_payments"], n=5).collect()}
    assert len(chosen) == 5 and all(i % 40 >= 32 and i % 365 >= 183 for i in chosen)


def test_root_causes(spark, edge_tables):
    t = edge_tables
    targets = spark.createDataFrame(
        [("2018-W01", "toys", 9.5, -3.0), ("2018-W02", "unknown", 8.0, -2.5), ("2018-W40", "toys", 1.0, -2.2)],
        "year_week string, category_en string, revenue_gap double, z_score double",
    )
    categories = facts.product_categories(t["products"], t["category_xlat"])
    rows = rc.target_rows(targets, t["orders"], t["order_items"], t["order_payments"], categories)
    states, sellers = rc.by_state(rows, t["sellers"]), rc.by_seller(rows, t["sellers"])
    found = {(r.year_week, r.seller_state): (r.orders, r.revenue, r.cancellations) for r in states.collect()}
    assert found == {("2018-W01", "SP"): (2, 26.35, 1), ("2018-W02", "SP"): (1, 5.5, 0)}
    report = rc.rca_report(targets, states, sellers).collect()
    assert [r.root_cause_seller for r in report] == ["s1", "s1", "unknown"]
    assert report[0].seller_cancel_rate == 33.3
    assert report[2].recommended_action == (
        "Investigate seller unknown in unknown — cancel rate 0.0% in toys during 2018-W40"
    )
    tiers = spark.createDataFrame([("u1", "High"), ("u2", None)], "customer_unique_id string, tier string")
    assert [(r.tier, r.orders, r.revenue) for r in rc.by_tier(rows, t["customers"], tiers).collect()] == [("High", 3, 26.35)]
    assert rp.rca_display(rc.rca_report(targets, states, sellers)).first().revenue_gap == "R$10"


def test_worst_seller_order(spark):
    rows = spark.createDataFrame(
        [("w", "c", f"s{i}", f"o{i}", status, 1, paid) for i, (status, paid) in enumerate(
            [("delivered", 500), ("canceled", 900), ("canceled", 800), ("canceled", 800), ("delivered", 1), ("delivered", 2), ("delivered", 3)])],
        "year_week string, category_en string, seller_id string, order_id string, order_status string, fan_rows long, fan_paid long",
    )
    sellers = spark.createDataFrame([(f"s{i}", "SP", "x") for i in range(7)], "seller_id string, seller_state string, seller_city string")
    worst = rc.by_seller(rows, sellers).orderBy("seller_rank").collect()
    assert [r.seller_id for r in worst] == ["s2", "s3", "s1", "s4", "s5"]


def test_kpis_without_anomalies(spark):
    totals = spark.createDataFrame(
        [(L1, 2, 10.5), (L2, 3, None), (L3, 0, 0.0), (L4, 4, 1234.0)], "detector string, flags long, revenue_at_risk double"
    )
    none = spark.createDataFrame([], "category_en string, year_week string, revenue_gap double")
    row = rp.summary_kpis(totals, none).first()
    assert (row.total_risk, row.active_anomalies, row.top_category, row.worst_week) == (1244.5, 9, "N/A", "N/A")
    assert rp.kpi_cards(rp.summary_kpis(totals, none)).first().total_risk == "R$1,244"
    shown = [r.display_value for r in rp.leakage_breakdown(totals).collect()]
    assert shown == ["R$0", "R$10", "R$1,234"]


def test_heatmap_matrix(spark):
    base = spark.createDataFrame(
        [(f"w{w:02d}", c, float(100 * i + w), None if w < 4 else float(w - i)) for i, c in enumerate("abc") for w in range(30)],
        "year_week string, category_en string, weekly_revenue double, z_score double",
    )
    cells = rp.zscore_heatmap(base, categories=2, weeks=20)
    assert {r.category_en for r in cells.collect()} == {"b", "c"} and cells.count() == 40
    wide = rp.heatmap_matrix(cells, ["w10", "w29"]).collect()
    assert [r.w29 for r in wide] == [28.0, 27.0]


def test_trailing_average(spark):
    monthly = spark.createDataFrame([("2018-01", 10.0), ("2018-02", 20.01), ("2018-03", 30.0), ("2018-04", 40.0)], "year_month string, monthly_revenue double")
    assert [r.rolling_avg for r in rp.revenue_with_average(monthly).collect()] == [10.0, 15.01, 20.0, 30.0]


def test_timeline_defaults_to_the_first_category(spark):
    base = spark.createDataFrame([("w1", "b"), ("w2", "a"), ("w1", "a")], "year_week string, category_en string")
    for c in ("weekly_revenue", "rolling_mean", "upper_bound", "lower_bound"):
        base = base.withColumn(c, F.lit(1.0))
    base = base.withColumn("is_anomaly", F.lit(False))
    assert [(r.category_en, r.year_week) for r in rp.category_timeline(base).collect()] == [("a", "w1"), ("a", "w2")]
    assert rp.category_timeline(base, "b").count() == 1
