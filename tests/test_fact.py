"""The shared order fact, the one-pass scorecard and the sliced row product."""

from __future__ import annotations

import pytest
from compare import rows_of
from pyspark.sql import functions as F

from marginwatch.operators import evaluation as ev, facts, leakage, metrics, trends
from marginwatch.plans import analysis as plans
from marginwatch.plans.analysis import Analysis, Trial
from marginwatch.plans.run import results
from marginwatch.sources.star import star_tables

BASE = "/root/testdata/sf0.001"


def same(a, b) -> bool:
    return rows_of(a.columns, [tuple(r) for r in a.collect()]) == rows_of(b.columns, [tuple(r) for r in b.collect()])


@pytest.mark.parametrize(
    "name",
    "overall_kpis monthly_revenue discount_depth weekly_revenue category_weekly geo_weekly customer_values "
    "customer_activity l1 l1_first l2 l4_flags l4_sellers".split(),
)
def test_shared_results_equal_single_ones(spark, edge_tables, shared, name):
    single = getattr(Analysis(edge_tables), name)
    got = getattr(shared, name).select(*single.columns)
    if name == "l4_flags":
        # a repeated order row is one flag with its number of rows
        def totals(df):
            return df.groupBy("order_id", "seller_id", "category_en").agg(F.sum("flag_rows"), F.sum("payment_value"))

        single, got = totals(single), totals(got)
    assert same(got, single)


@pytest.fixture(scope="module")
def shared(edge_tables):
    return Analysis(edge_tables, shared=True)


def test_a_full_run_scans_items_twice(spark, monkeypatch):
    """Once for the quality report, once for the fact."""
    scans = []
    staged = plans.staged

    def counted(df, *args):
        scans.append("l_partkey" in df._jdf.queryExecution().executedPlan().toString())
        return staged(df, *args)

    monkeypatch.setattr(plans, "staged", counted)
    found = results(star_tables(spark, BASE))
    lines = sum("l_orderkey" in df._jdf.queryExecution().executedPlan().toString() for df in found.values())
    assert lines == 1, [n for n, df in found.items() if "l_orderkey" in df._jdf.queryExecution().executedPlan().toString()]
    assert sum(scans) == 1


def repeated(spark, rows: int):
    """``rows`` equal orders of one id with as many lines of one seller each."""
    orders = spark.range(rows).selectExpr(
        "'a' AS order_id", "'c' AS customer_id", "'delivered' AS order_status",
        "timestamp_ntz'2018-01-01 10:00:00' AS order_purchase_timestamp",
        "timestamp_ntz'2018-01-05 10:00:00' AS order_delivered_customer_date",
    )
    items = spark.range(rows).selectExpr(
        "'a' AS order_id", "'p' AS product_id", "CAST(id AS STRING) AS seller_id", "1.0D AS price", "0.5D AS freight_value"
    )
    payments = spark.sql("SELECT 'a' AS order_id, 2.0D AS payment_value")
    products = spark.sql("SELECT 'p' AS product_id, 'x' AS product_category_name")
    names = spark.sql("SELECT 'x' AS product_category_name, 'toys' AS product_category_name_english")
    return orders, items, payments, products, names


def test_repeated_order_ids_make_no_row_product(spark):
    orders, items, payments, products, names = repeated(spark, 400)
    fact = facts.order_fact(facts.paid_orders(orders, payments), items, products, names)
    assert fact.count() == 400
    assert fact.agg(F.sum("fan_rows"), F.sum("line_rows")).first() == (160_000, 160_000)
    lines = facts.order_lines(items, "seller_id")
    joined = facts.joined_rows(facts.orders_with(orders, []), lines, payments)
    assert joined.count() == 400 and joined.agg(F.sum("fan_rows")).first()[0] == 160_000
    week = trends.category_weekly(orders, items, payments, products, names).first()
    assert (week.orders_count, week.weekly_revenue) == (1, 320_000.0)
    assert leakage.refund_rates(orders, items, products, names).first().total_orders == 1
    assert metrics.category_revenue(orders, items, payments, products, names).first().total_revenue == 320_000.0


def test_a_heavy_order_is_built_by_several_tasks(spark):
    orders, items, payments, products, names = repeated(spark, 600)
    others = [x.withColumn("order_id", F.concat(F.lit("o"), F.col("seller_id"))) for x in (items, items)]
    items = items.union(others[0]).union(others[1])
    orders = orders.limit(1)
    payments = payments.union(spark.range(2).selectExpr("'a'", "3.0D"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = leakage.short_lifecycle_orders(orders, items, payments, products, names, slice_rows=50)
        per_task = rows.groupBy(F.spark_partition_id()).count().collect()
        assert rows.groupBy("payment_value").count().sort("payment_value").collect() == [(2.0, 600), (3.0, 1200)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per_task) >= 3
    assert rows.select("seller_id", "payment_value").distinct().count() == 1200


def test_detectors_judged_together_equal_single_judgements(spark):
    def keys(*values):
        return spark.createDataFrame([(v,) for v in values], "order_id string")

    sets = [
        {"flagged": keys("a", "b", "b"), "truth": keys("b", "c"), "keys": ["order_id"], "detector": "one"},
        {"flagged": keys("a", "a", None), "truth": keys("a"), "keys": ["order_id"], "detector": "two", "count_rows": True},
        {"flagged": keys(), "truth": keys(), "keys": ["order_id"], "detector": "none"},
        {"flagged": keys(), "truth": keys("x"), "keys": ["order_id"], "detector": "rows", "flag_rows": keys("p", "q")},
    ]
    got = ev.scorecard(sets).collect()
    assert [tuple(r)[:5] for r in got] == [
        ("none", 0, 0, 0, 0),
        ("one", 2, 1, 1, 1),
        ("rows", 2, 0, 0, 1),
        ("two", 3, 1, 1, 0),
    ]
    single = {x["detector"]: ev.evaluate(**x).first() for x in sets}
    assert all(r == single[r.detector] for r in got)


def test_the_scorecard_reads_the_planted_tables_once(spark, monkeypatch):
    scans = []
    staged = plans.staged

    def counted(df, *args):
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans.append(("l_orderkey" in plan, "l_partkey" in plan))
        return staged(df, *args)

    trial = Trial(star_tables(spark, BASE), "Brand#11").share()
    trial.labels, trial.resolved_labels
    monkeypatch.setattr(plans, "staged", counted)
    card = trial.scorecard()
    assert "l_orderkey" not in card._jdf.queryExecution().executedPlan().toString()
    # orders with payments, then their lines; in the test tables all of these come from one table
    assert [x for x in scans if any(x)] == [(True, False), (True, True)]


@pytest.mark.parametrize("dedupe", [False, True])
def test_weekly_reports_count_rows_of_orders_and_weeks_instead_of_ids(spark, dedupe):
    """A distinct count would hold every order of a task; repeated ids of any week and status count as before."""
    orders = spark.sql(
        "SELECT order_id, status AS order_status, CAST(day AS TIMESTAMP_NTZ) AS order_purchase_timestamp FROM VALUES "
        "('a', 'delivered', '2018-01-01'), ('a', 'canceled', '2018-01-02'), ('a', 'canceled', '2018-01-09'), "
        "('a', NULL, '2018-01-03'), ('a', 'canceled', NULL), ('b', 'canceled', '2018-01-01'), ('c', 'shipped', '2018-01-01') "
        "AS t(order_id, status, day)"
    )
    items = spark.sql("SELECT * FROM VALUES ('a', 'p', 's'), ('a', 'p', 's'), ('a', 'q', 's'), ('b', 'p', 't'), ('c', 'p', 's') "
                      "AS t(order_id, product_id, seller_id)")  # fmt: skip
    payments = spark.sql("SELECT * FROM VALUES ('a', 2.0D), ('a', 4.0D), ('b', 8.0D), ('b', 0.0D), ('c', 0.0D) "
                         "AS t(order_id, payment_value)")  # fmt: skip
    products = spark.sql("SELECT * FROM VALUES ('p', 'x'), ('q', NULL) AS t(product_id, product_category_name)")
    names = spark.sql("SELECT 'x' AS product_category_name, 'toys' AS product_category_name_english")
    sellers = spark.sql("SELECT * FROM VALUES ('s', 'SP'), ('t', 'RJ') AS t(seller_id, seller_state)")

    def product(lines, key):
        lines = lines.select("order_id", key)
        rows = orders.join(lines.distinct() if dedupe else lines, "order_id").join(payments.filter("payment_value > 0"), "order_id")
        week = "CASE WHEN order_purchase_timestamp < '2018-01-08' THEN '2018-W01' ELSE '2018-W02' END"
        return rows.filter("order_purchase_timestamp IS NOT NULL").groupBy(F.expr(week).alias("year_week"), key).agg(
            F.count_distinct("order_id").alias("orders_count"),
            F.sum("payment_value").alias("weekly_revenue"),
            F.avg("payment_value").alias("avg_order_value"),
            F.count_if(F.col("order_status") == "canceled").alias("cancellations"),
        )

    named = items.join(facts.product_categories(products, names), "product_id")
    by_category = trends.category_weekly(orders, items, payments, products, names, dedupe)
    by_state = trends.geo_weekly(orders, items, payments, sellers, dedupe)
    assert same(by_category, product(named, "category_en").withColumn("avg_order_value", F.round("avg_order_value", 2)))
    assert same(by_state, product(items.join(sellers, "seller_id"), "seller_state").drop("avg_order_value"))
    assert by_category.count() == 4 and by_state.count() == 3
    for df in (by_category, by_state):
        assert "distinct" not in df._jdf.queryExecution().executedPlan().toString()
