from __future__ import annotations

import numpy as np
import pytest

from marginwatch.operators.quantile import exact_quantiles


def _cases():
    rng = np.random.default_rng(7)
    spread = np.round(rng.lognormal(4, 3, 3000), 2)
    hot = np.concatenate([np.full(2000, 19.99), spread[:4000]])
    return {
        "spread": spread,
        "one value holds a third": hot,
        "negative": np.round(rng.normal(0, 500, 501), 2),
        "far apart": np.array([0.01, 5.0, 9e10, 8e10, 123456789.12]),
        "single": np.array([3.5]),
        "equal": np.full(9, 2.25),
    }


@pytest.mark.parametrize("name", list(_cases()))
def test_matches_numpy(spark, name):
    values = _cases()[name]
    probabilities = [0.0, 0.4, 0.5, 0.8, 1.0]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = exact_quantiles(df, "v", probabilities).first()
    assert list(got) == pytest.approx(list(np.quantile(values, probabilities)), rel=1e-12)


def test_empty_input_gives_nulls(spark):
    assert list(exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.8]).first()) == [None]


def test_quantiles_share_one_shuffle_of_the_values(spark):
    """Only the counters and ranks are shuffled, never the values themselves to one task."""
    df = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS v")
    plan = exact_quantiles(df, "v", [0.8])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "percentile" not in plan
