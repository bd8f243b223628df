from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from marginwatch.functions import labels, money, timekeys


def test_week_keys_match_the_c_library(spark):
    days = [(datetime(2010, 1, 1) + timedelta(days=i),) for i in range(0, 7670)]
    rows = (
        spark.createDataFrame(days, "ts timestamp_ntz")
        .select("ts", timekeys.year_week("ts").alias("w"), timekeys.iso_week("ts").alias("iso"))
        .collect()
    )
    assert all(r.w == r.ts.strftime("%Y-W%W") for r in rows)
    assert all(r.iso == r.ts.isocalendar()[1] for r in rows)


def test_whole_days_truncate_toward_zero(spark):
    pairs = [
        (datetime(2020, 1, 3, 11), datetime(2020, 1, 1, 12), 1),
        (datetime(2020, 1, 3, 12), datetime(2020, 1, 1, 12), 2),
        (datetime(2020, 1, 1), datetime(2020, 1, 2, 12), -1),
        (None, datetime(2020, 1, 2, 12), None),
    ]
    df = spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz, want int")
    assert df.select(timekeys.whole_days(F.col("a"), F.col("b")).alias("d"), "want").filter(
        "NOT d <=> want"
    ).count() == 0


def test_month_key_round_trip(spark):
    row = spark.createDataFrame([(datetime(2018, 7, 9),)], "ts timestamp_ntz").select(
        timekeys.year_month("ts").alias("m"), timekeys.month_start(timekeys.year_month("ts")).alias("d")
    )
    assert tuple(row.first()) == ("2018-07", date(2018, 7, 1))


def test_bins_are_closed_on_the_right(spark):
    values = [(0.0,), (-1.0,), (10.0,), (10.01,), (20.0,), (20.01,), (None,)]
    tiers = spark.createDataFrame(values, "v double").select(labels.tier(F.col("v"), F.lit(10.0), F.lit(20.0)))
    assert [r[0] for r in tiers.collect()] == [None, None, "Low", "Mid", "Mid", "High", None]
    zs = [(-3.01,), (-3.0,), (-2.5,), (-2.49,), (-2.0,), (-1.99,), (None,)]
    found = spark.createDataFrame(zs, "z double").select(labels.severity(F.col("z"))).collect()
    assert [r[0] for r in found] == ["Critical", "Critical", "High", "Medium", "Medium", None, None]


def test_quotients_round_half_up_and_guard_zero(spark):
    df = spark.createDataFrame([(10001, 200), (-10001, 200), (1, 0)], "a long, b long")
    got = [r[0] for r in df.select(money.ratio(F.col("a"), F.col("b"), 2)).collect()]
    assert got == [50.01, -50.01, None]


def test_cents_and_text(spark):
    row = (
        spark.createDataFrame([(0.29, 1234567.5)], "a double, b double")
        .select(money.cents("a").alias("a"), money.currency("b").alias("b"))
        .first()
    )
    assert (row.a, row.b) == (29, "R$1,234,568")


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "v double")
    assert [r[0] for r in df.select(money.clip_low(F.col("v"))).collect()] == [0.0, 2.0, None]
