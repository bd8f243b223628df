from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginwatch.operators import baseline as bl, forest, leakage, trends


def _weekly(spark, seed=3, weeks=40, categories=("calm", "flat", "short", "wild")):
    rng = np.random.default_rng(seed)
    rows = []
    for c in categories:
        for w in range(3 if c == "short" else weeks):
            revenue = 700.0 if c == "flat" else round(float(rng.lognormal(7, 0.4)), 2)
            orders = int(rng.integers(1, 20))
            rows.append((f"2017-W{w:02d}", c, orders, revenue, round(revenue / orders, 2), int(rng.integers(0, 2))))
    return pd.DataFrame(
        rows,
        columns=["year_week", "category_en", "orders_count", "weekly_revenue", "avg_order_value", "cancellations"],
    )


@pytest.fixture(scope="module")
def weekly(spark):
    return _weekly(spark)


@pytest.fixture(scope="module")
def base(spark, weekly):
    return bl.rolling_baseline(spark.createDataFrame(weekly))


def test_baseline_matches_pandas(base, weekly):
    got = base.toPandas().set_index(["category_en", "year_week"]).sort_index()
    for category, group in weekly.groupby("category_en"):
        group = group.sort_values("year_week")
        past = group.weekly_revenue.shift(1).rolling(8, min_periods=4)
        mean, std, median = past.mean(), past.std(), past.median()
        z = (group.weekly_revenue - mean) / std.where(std > 1e-9)
        lower = (mean - 2 * std).clip(lower=0)
        mine = got.loc[category]
        for column, want in {
            "rolling_mean": mean,
            "rolling_std": std,
            "rolling_median": median,
            "upper_bound": mean + 2 * std,
            "lower_bound": lower,
            "z_score": z,
            "revenue_at_risk": (lower - group.weekly_revenue).clip(lower=0),
        }.items():
            np.testing.assert_allclose(mine[column].astype(float), want, atol=0.0051, err_msg=column)


def test_short_and_flat_categories(base):
    rows = base.toPandas()
    assert rows[rows.category_en == "short"].rolling_mean.isna().all()
    flat = rows[(rows.category_en == "flat") & rows.rolling_mean.notna()]
    assert (flat.rolling_std == 0).all() and flat.z_score.isna().all() and not flat.is_anomaly.any()


def test_zscore_threshold_is_strict_and_on_the_rounded_value(spark, base):
    schema = base.schema
    proto = base.filter("rolling_mean IS NOT NULL").limit(1).collect()[0].asDict()
    rows = [
        {**proto, "year_week": f"w{i}", "z_score": z, "rolling_mean": m}
        for i, (z, m) in enumerate([(-2.0, 900.0), (-2.01, 900.0), (-3.0, 500.0), (-3.0, 499.99), (None, 900.0)])
    ]
    flags = bl.zscore_anomalies(spark.createDataFrame(rows, schema)).collect()
    assert [(r.year_week, r.severity) for r in flags] == [("w1", "Medium"), ("w2", "Critical")]
    assert flags[0].revenue_gap == pytest.approx(900.0 - proto["weekly_revenue"])


def test_first_discount_version_contains_the_tuned_one(spark):
    rng = np.random.default_rng(1)
    n = 200
    ids = [str(i) for i in range(n)]
    orders = spark.createDataFrame(
        [(i, "delivered") for i in ids], "order_id string, order_status string"
    ).withColumn("order_purchase_timestamp", F.expr("TIMESTAMP_NTZ '2018-01-01 00:00:00'"))
    items = spark.createDataFrame([(i, 100.0, 0.0) for i in ids], "order_id string, price double, freight_value double")
    pays = spark.createDataFrame([(i, float(p)) for i, p in zip(ids, rng.integers(50, 101, n))], "order_id string, payment_value double")
    first = {r.order_id for r in leakage.discount_abuse(orders, items, pays, 20.0).collect()}
    tuned = {r.order_id for r in leakage.discount_abuse(orders, items, pays, 30.0).collect()}
    assert tuned < first


def test_refund_baseline_matches_pandas(spark):
    rng = np.random.default_rng(5)
    rates = pd.DataFrame(
        [(f"2018-W{w:02d}", c, 10, 1, round(float(rng.random() * 20), 2)) for c in "ab" for w in range(30)],
        columns=["year_week", "category_en", "total_orders", "cancellations", "cancel_rate_pct"],
    )
    got = leakage.refund_baseline(spark.createDataFrame(rates)).toPandas().sort_values(["category_en", "year_week"])
    past = rates.groupby("category_en").cancel_rate_pct.transform(lambda s: s.shift(1).rolling(8, min_periods=4).mean())
    dev = rates.groupby("category_en").cancel_rate_pct.transform(lambda s: s.shift(1).rolling(8, min_periods=4).std())
    np.testing.assert_allclose(got.rolling_cancel_mean, past)
    np.testing.assert_allclose(got.cancel_z_score, (rates.cancel_rate_pct - past) / dev)
    assert (got.is_refund_spike.to_numpy() == ((rates.cancel_rate_pct - past) / dev > 2).to_numpy()).all()


def test_churn_edges(spark):
    rows = [
        ("kept", "2018-06-30 00:00:00", 5, 500.0),
        ("exactly", "2018-04-01 00:00:00", 2, 500.0),
        ("almost", "2018-04-02 00:00:00", 2, 500.0),
        ("single", "2018-01-01 00:00:00", 1, 500.0),
        ("poor", "2018-01-01 00:00:00", 9, 1.0),
    ]
    totals = spark.createDataFrame(rows, "customer_unique_id string, t string, total_orders long, lifetime_value double")
    totals = totals.withColumn("last_order_date", F.col("t").cast("timestamp_ntz"))
    churned = leakage.silent_churn(totals).collect()
    assert [(r.customer_unique_id, r.days_inactive) for r in churned] == [("exactly", 90)]
    assert {r.customer_unique_id for r in leakage.silent_churn(totals, 180, 1).collect()} == {"single"}


def test_lifecycle_rows_agree_with_flags(edge_tables):
    t = edge_tables
    args = (t["orders"], t["order_items"], t["order_payments"], t["products"], t["category_xlat"])
    rows = leakage.short_lifecycle_orders(*args).toPandas()
    flags = leakage.short_lifecycle_flags(leakage.lifecycle_lines(*args)).toPandas()
    assert len(rows) == flags.flag_rows.sum() == 4 + 1 + 2
    assert rows.payment_value.sum() == pytest.approx(flags.payment_value.sum())
    assert rows[rows.order_id == "d"].lifecycle_days.tolist() == [-1]
    pairs = leakage.short_lifecycle_sellers(leakage.lifecycle_lines(*args), min_rows=2).toPandas()
    assert set(zip(pairs.seller_id, pairs.category_en)) == {("s1", "toys"), ("s2", "untranslated"), ("s3", "untranslated")}


def test_detector_totals_sum_up(edge_tables):
    t = edge_tables
    args = (t["orders"], t["order_items"], t["order_payments"])
    catalog = (t["products"], t["category_xlat"])
    l1 = leakage.discount_abuse(*args)
    l2 = leakage.refund_spikes(t["orders"], t["order_items"], *catalog)
    l3 = leakage.silent_churn(trends.customer_totals(t["orders"], t["order_payments"], t["customers"]))
    l4 = leakage.short_lifecycle_flags(leakage.lifecycle_lines(*args, *catalog))
    amounts = {r.detector: r.revenue_at_risk for r in leakage.revenue_at_risk(leakage.detector_totals(l1, l2, l3, l4)).collect()}
    assert amounts["total"] == pytest.approx(sum(v for k, v in amounts.items() if k != "total"))
    assert amounts["L1_discount_abuse"] == pytest.approx(l1.toPandas().actual_paid.sum())


def _scores(spark, frame, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        features = forest.forest_features(bl.rolling_baseline(spark.createDataFrame(frame)))
        return forest.forest_scores(features).toPandas().sort_values(["category_en", "year_week"]).reset_index(drop=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_forest_finds_a_planted_outlier_and_repeats(spark):
    frame = _weekly(spark, weeks=52)
    odd = frame[(frame.category_en == "calm") & (frame.year_week == "2017-W30")].index[0]
    frame.loc[odd, ["weekly_revenue", "orders_count", "avg_order_value"]] = [90000.0, 400, 225.0]
    scores = _scores(spark, frame, 8)
    assert set(scores.category_en) == {"calm", "flat", "wild"}
    calm = scores[scores.category_en == "calm"]
    assert calm.loc[calm.if_score.idxmin(), "year_week"] == "2017-W30"
    assert ((scores.if_score < 0) & (scores.if_score > -1)).all()
    share = scores.groupby("category_en").if_anomaly.mean()
    assert ((share > 0) & (share <= 0.06)).all()
    pd.testing.assert_frame_equal(scores, _scores(spark, frame, 3))


def test_forest_samples_long_categories(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=(599, 6)), np.full((1, 6), 9.0)])
    depths = forest.isolation_depths(values, np.arange(40, dtype=np.int64) * 104729 + 5, 256).mean(axis=0)
    assert depths.argmin() == 599
    constant = forest.isolation_depths(np.ones((20, 6)), np.arange(3, dtype=np.int64), 256)
    assert np.allclose(constant, constant[0, 0])
