"""Documented leakage definitions and thresholds as parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    """Fixed values of the analyses; every operator takes them as arguments."""

    # rolling baseline
    window_weeks: int = 8
    min_weeks: int = 4
    band_sigmas: float = 2.0
    # z-score detector
    zscore_below: float = -2.0
    min_expected_revenue: float = 500.0
    # isolation forest
    trees: int = 100
    sample_size: int = 256
    contamination: float = 0.05
    min_category_weeks: int = 12
    seed: int = 42
    # discount abuse: share of list price not paid, first and tuned version
    discount_pct_first: float = 20.0
    discount_pct: float = 30.0
    # refund spike
    refund_sigmas: float = 2.0
    # silent churn, first and tuned version
    churn_days_first: int = 180
    churn_days: int = 90
    churn_min_orders: int = 2
    high_value_quantile: float = 0.80
    # short lifecycle: order level, and seller x category level
    short_days: int = 20
    seller_short_days: int = 30
    seller_short_rate_pct: float = 25.0
    seller_min_rows: int = 5
    # customer tiers
    tier_quantiles: tuple[float, float] = (0.40, 0.80)


RULES = Rules()
