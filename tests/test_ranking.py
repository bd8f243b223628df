from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginwatch.operators import ranking, trends


def _expected(values: pd.Series) -> pd.Series:
    if len(values) == 1:
        return pd.Series([0.0], index=values.index)
    return (values.rank(method="min") - 1) / (len(values) - 1)


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_percent_rank_with_a_value_held_by_half_of_all_rows(spark, ranges):
    rng = np.random.default_rng(5)
    values = np.concatenate([np.full(1000, 50.0), rng.integers(0, 100, 900) / 1.0, [0.0] * 100])
    rows = pd.DataFrame({"id": np.arange(len(values)), "v": rng.permutation(values)})
    got = ranking.percent_ranks(spark.createDataFrame(rows), "v", "id", ranges).toPandas().set_index("id").sort_index()
    np.testing.assert_allclose(got.percent_rank, _expected(rows.v))
    assert (got.smaller == rows.v.rank(method="min") - 1).all()


def test_a_common_value_is_ranked_by_several_tasks(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.col("id") * 1.0).alias("v"))
    dealt = rows.repartitionByRange(8, "v", "id").groupBy(F.spark_partition_id().alias("p")).agg(
        F.count_if(F.col("v") == 1.0).alias("n")
    )
    assert dealt.where("n > 0").count() >= 3
    assert ranking.percent_ranks(rows, "v", "id", 8).where("v = 1").agg(F.max("smaller")).first()[0] == 0


def test_percent_rank_of_nulls_single_rows_and_nothing(spark):
    kind = "id long, v double"
    got = ranking.percent_ranks(spark.createDataFrame([(1, None), (2, 3.0)], kind), "v", "id").collect()
    assert sorted(map(tuple, got)) == [(1, None, None, None), (2, 3.0, 0, 0.0)]
    assert ranking.percent_ranks(spark.createDataFrame([], kind), "v", "id").count() == 0
    twice = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 9.0)], kind)
    assert sorted(r.percent_rank for r in ranking.percent_ranks(twice, "v", "id", 3).collect()) == [0, 0, 1]


def test_no_window_over_all_customers(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 10).cast("double").alias("lifetime_value"))
    ranked = trends.ranked_customers(rows.withColumnRenamed("id", "customer_unique_id"))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    # the one window without a key runs on a line per range
    assert "customer_unique_id" not in "".join(x for x in plan.split("\n") if "SinglePartition" in x)
    tiers = {r.tier: r.n for r in ranked.groupBy("tier").agg(F.count("*").alias("n")).collect()}
    assert tiers == {"High": 200, "Mid": 400, "Low": 400}
