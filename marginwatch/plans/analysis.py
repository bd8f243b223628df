"""All results of one set of tables as lazy DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from marginwatch.functions import labels
from marginwatch.operators import (
    baseline as bl,
    evaluation as ev,
    facts,
    forest as fo,
    leakage as lk,
    metrics as me,
    perturb as px,
    quality as qu,
    reporting as rp,
    root_cause as rc,
    trends as tr,
)
from marginwatch.rules import RULES, Rules
from marginwatch.sources.stage import staged

Tables = dict[str, DataFrame]


class Analysis:
    """Each attribute is one result over the given tables.

    Inputs that several results or several branches of one result read are staged, so
    the large tables are joined once for them: the weekly baseline, the totals per
    customer, the forest's scores and the few root-cause targets.

    ``shared`` is for callers that want several results: orders with payments are joined and staged
    once, and so are their lines (``fact``), and all results but the quality report read those two. For
    a single result a narrower join of its own is less work.
    """

    def __init__(self, tables: Tables, rules: Rules = RULES, shared: bool = False):
        self.tables, self.rules, self.shared = tables, rules, shared
        self.orders, self.items, self.payments = (
            tables["orders"],
            tables["order_items"],
            tables["order_payments"],
        )
        self.catalog = (tables["products"], tables["category_xlat"])

    # what all results share
    @cached_property
    def all_orders(self) -> DataFrame:
        """Order rows with their payments, if any."""
        rows = facts.paid_orders(self.orders, self.payments)
        return staged(rows) if self.shared else rows

    @cached_property
    def paid(self) -> DataFrame:
        return self.all_orders.filter(F.col("payment_rows").isNotNull())

    @cached_property
    def fact(self) -> DataFrame:
        rows = facts.order_fact(self.all_orders, self.items, *self.catalog)
        return staged(rows) if self.shared else rows

    # quality and KPIs
    @cached_property
    def dq_report(self) -> DataFrame:
        return qu.quality_report(self.orders, self.items, self.payments)

    @cached_property
    def overall_kpis(self) -> DataFrame:
        return me.kpis_of(self.paid) if self.shared else me.overall_kpis(self.orders, self.payments)

    @cached_property
    def monthly_revenue(self) -> DataFrame:
        return me.months_of(self.paid) if self.shared else me.monthly_revenue(self.orders, self.payments)

    @cached_property
    def monthly_refund_rate(self) -> DataFrame:
        return me.monthly_refund_rate(self.orders)

    @cached_property
    def discount_depth(self) -> DataFrame:
        if self.shared:
            return me.depth_of(me.fact_discounts(self.fact))
        return me.discount_depth(self.orders, self.items, self.payments)

    @cached_property
    def top_categories(self) -> DataFrame:
        if self.shared:
            return me.top_categories(me.categories_of(facts.priced_lines(self.fact)))
        return me.top_categories(me.category_revenue(self.orders, self.items, self.payments, *self.catalog))

    # trends
    @cached_property
    def weekly_revenue(self) -> DataFrame:
        return tr.weeks_of(self.paid) if self.shared else tr.weekly_revenue(self.orders, self.payments)

    @cached_property
    def category_weekly(self) -> DataFrame:
        if self.shared:
            return tr.category_weeks_of(facts.priced_lines(self.fact))
        return tr.category_weekly(self.orders, self.items, self.payments, *self.catalog)

    @cached_property
    def geo_weekly(self) -> DataFrame:
        if self.shared:
            return tr.fact_state_weeks(self.fact, self.tables["sellers"])
        return tr.geo_weekly(self.orders, self.items, self.payments, self.tables["sellers"])

    def _customer_totals(self, delivered: bool) -> DataFrame:
        customers = self.tables["customers"]
        rows = self.paid if self.shared else self.orders
        rows = rows.filter(labels.delivered()) if delivered else rows
        return tr.totals_of(rows, customers) if self.shared else tr.customer_totals(rows, self.payments, customers)

    @cached_property
    def customer_values(self) -> DataFrame:
        return staged(self._customer_totals(delivered=True).select("customer_unique_id", "lifetime_value"))

    @cached_property
    def customer_activity(self) -> DataFrame:
        return staged(self._customer_totals(delivered=False))

    @cached_property
    def customer_tiers(self) -> DataFrame:
        return tr.customer_tiers(self.customer_values, self.rules.tier_quantiles)

    @cached_property
    def tier_summary(self) -> DataFrame:
        return tr.tier_summary(self.customer_tiers)

    @cached_property
    def ranked_customers(self) -> DataFrame:
        return tr.ranked_customers(self.customer_values, self.rules.tier_quantiles)

    # baseline and anomalies
    @cached_property
    def baseline(self) -> DataFrame:
        r = self.rules
        return bl.rolling_baseline(self.category_weekly, r.window_weeks, r.min_weeks, r.band_sigmas)

    @cached_property
    def staged_baseline(self) -> DataFrame:
        return staged(self.baseline)

    @cached_property
    def full_weeks_baseline(self) -> DataFrame:
        """The baseline without an incomplete last week, for feeds that are still running."""
        r = self.rules
        weekly = tr.full_weeks(self.category_weekly, self.orders)
        return bl.rolling_baseline(weekly, r.window_weeks, r.min_weeks, r.band_sigmas)

    @cached_property
    def anomaly_summary(self) -> DataFrame:
        return bl.anomaly_summary(self.staged_baseline)

    @cached_property
    def zscore(self) -> DataFrame:
        return bl.zscore_anomalies(self.staged_baseline, self.rules.zscore_below, self.rules.min_expected_revenue)

    @cached_property
    def staged_zscore(self) -> DataFrame:
        return staged(self.zscore)

    @cached_property
    def forest_features(self) -> DataFrame:
        return fo.forest_features(self.staged_baseline, self.rules.window_weeks, self.rules.min_weeks)

    @cached_property
    def forest_scores(self) -> DataFrame:
        r = self.rules
        return fo.forest_scores(
            staged(self.forest_features),
            r.trees,
            r.sample_size,
            r.contamination,
            r.min_category_weeks,
            r.seed,
            r.zscore_below,
        )

    @cached_property
    def staged_scores(self) -> DataFrame:
        return staged(self.forest_scores)

    @cached_property
    def high_confidence(self) -> DataFrame:
        return fo.high_confidence(self.staged_scores)

    # leakage detectors, first and tuned versions
    def _abuse(self, threshold_pct: float) -> DataFrame:
        if self.shared:
            return lk.abuse_of(me.fact_discounts(self.fact), threshold_pct)
        return lk.discount_abuse(self.orders, self.items, self.payments, threshold_pct)

    @cached_property
    def l1_first(self) -> DataFrame:
        return self._abuse(self.rules.discount_pct_first)

    @cached_property
    def l1(self) -> DataFrame:
        return self._abuse(self.rules.discount_pct)

    @cached_property
    def l2(self) -> DataFrame:
        r = self.rules
        if self.shared:
            rates = lk.refund_rates_of(self.fact.filter("known"))
            return lk.spikes_of(rates, r.window_weeks, r.min_weeks, r.refund_sigmas)
        return lk.refund_spikes(
            self.orders, self.items, *self.catalog, r.window_weeks, r.min_weeks, r.refund_sigmas
        )

    @cached_property
    def l3_first(self) -> DataFrame:
        return lk.silent_churn(
            self.customer_activity, self.rules.churn_days_first, 1, self.rules.high_value_quantile
        )

    @cached_property
    def l3(self) -> DataFrame:
        return lk.silent_churn(
            self.customer_activity,
            self.rules.churn_days,
            self.rules.churn_min_orders,
            self.rules.high_value_quantile,
        )

    @cached_property
    def l4(self) -> DataFrame:
        return lk.short_lifecycle_orders(
            self.orders, self.items, self.payments, *self.catalog, days=self.rules.short_days
        )

    @cached_property
    def lifecycle_lines(self) -> DataFrame:
        if self.shared:
            return lk.fact_lifecycle_lines(self.fact)
        return lk.lifecycle_lines(self.orders, self.items, self.payments, *self.catalog)

    @cached_property
    def l4_flags(self) -> DataFrame:
        return lk.short_lifecycle_flags(self.lifecycle_lines, self.rules.short_days)

    @cached_property
    def l4_sellers(self) -> DataFrame:
        r = self.rules
        return lk.short_lifecycle_sellers(
            self.lifecycle_lines, r.seller_short_days, r.seller_short_rate_pct, r.seller_min_rows
        )

    @cached_property
    def detector_totals(self) -> DataFrame:
        """Four rows that every report on risk reads, and the detectors behind them run once."""
        return staged(lk.detector_totals(self.l1, self.l2, self.l3, self.l4_flags))

    # root causes
    @cached_property
    def rca_targets(self) -> DataFrame:
        return staged(rc.rca_targets(self.high_confidence))

    @cached_property
    def rca_rows(self) -> DataFrame:
        """The targets' rows, read by all three drill-downs."""
        if self.shared:
            return staged(rc.fact_target_rows(self.rca_targets, self.fact))
        categories = facts.product_categories(*self.catalog)
        return staged(rc.target_rows(self.rca_targets, self.orders, self.items, self.payments, categories))

    @cached_property
    def rca_state(self) -> DataFrame:
        return rc.by_state(self.rca_rows, self.tables["sellers"])

    @cached_property
    def rca_seller(self) -> DataFrame:
        return rc.by_seller(self.rca_rows, self.tables["sellers"])

    @cached_property
    def rca_tier(self) -> DataFrame:
        return rc.by_tier(self.rca_rows, self.tables["customers"], self.customer_tiers)

    @cached_property
    def rca_report(self) -> DataFrame:
        return rc.rca_report(self.rca_targets, self.rca_state, self.rca_seller)

    # reporting
    @cached_property
    def summary_kpis(self) -> DataFrame:
        return rp.summary_kpis(self.detector_totals, self.staged_zscore)

    @cached_property
    def dataset_stats(self) -> DataFrame:
        return rp.dataset_stats(self.monthly_revenue, self.staged_baseline, self.zscore)


class Trial:
    """Detectors run on tables with planted leakage and scored against its labels."""

    def __init__(self, raw: Tables, category: str, rules: Rules = RULES):
        self.raw = raw
        # A few hundred rows that the planted tables and every evaluation read.
        self.labels = staged(px.labels_table(px.planting_targets(raw, category)))
        self.rules = rules
        self.use(px.plant(raw, {kind: ev.labels_of(self.labels, kind) for kind in labels.DISPLAY_NAMES}))

    def use(self, planted: Tables, shared: bool = False) -> Trial:
        """Take the planted tables from here, for instance from a staged copy."""
        self.planted = planted
        self.analysis = Analysis(planted, self.rules, shared)
        return self

    def share(self) -> Trial:
        """Plant, and join the planted tables, once for several evaluations."""
        return self.use(self.planted, shared=True)

    @cached_property
    def resolved_labels(self) -> DataFrame:
        return staged(ev.resolve_labels(self.labels, self.raw["orders"]))

    @cached_property
    def truth(self) -> DataFrame:
        return ev.truth_category_weeks(self.resolved_labels, self.raw["order_items"], *self.analysis.catalog)

    @cached_property
    def eval_zscore(self) -> DataFrame:
        return ev.evaluate_category_weeks(self.analysis.zscore, self.truth, "Z-Score")

    @cached_property
    def eval_forest(self) -> DataFrame:
        return ev.evaluate_category_weeks(self.analysis.high_confidence, self.truth, "Isolation Forest")

    def discount_sets(self, tuned: bool = True) -> dict:
        return ev.discount_sets(self.analysis.l1 if tuned else self.analysis.l1_first, self.labels)

    def refund_sets(self) -> dict:
        a = self.analysis
        return ev.refund_sets(a.l2, self.labels, a.all_orders if a.shared else self.planted["orders"])

    def churn_sets(self, tuned: bool = True) -> dict:
        flags = self.analysis.l3 if tuned else self.analysis.l3_first
        return ev.churn_sets(flags, self.resolved_labels, self.raw["customers"])

    def lifecycle_sets(self, tuned: bool = True) -> dict:
        a, r = self.analysis, self.rules
        if tuned:
            return ev.lifecycle_sets(a.l4_flags, self.labels)
        lines = a.lifecycle_lines if a.shared else staged(a.lifecycle_lines)
        sellers = lk.short_lifecycle_sellers(lines, r.seller_short_days, r.seller_short_rate_pct, r.seller_min_rows)
        short = lk.short_lifecycle_flags(lines, r.seller_short_days)
        return ev.lifecycle_seller_sets(sellers, short, self.labels)

    # the first versions were judged with F1 of rounded precision and recall
    def eval_l1(self, tuned: bool = True) -> DataFrame:
        return ev.evaluate(**self.discount_sets(tuned), f1_of_rounded=not tuned)

    def eval_l2(self, tuned: bool = True) -> DataFrame:
        return ev.evaluate(**self.refund_sets(), f1_of_rounded=not tuned)

    def eval_l3(self, tuned: bool = True) -> DataFrame:
        return ev.evaluate(**self.churn_sets(tuned), f1_of_rounded=not tuned)

    def eval_l4(self, tuned: bool = True) -> DataFrame:
        return ev.evaluate(**self.lifecycle_sets(tuned), f1_of_rounded=not tuned)

    def scorecard(self, tuned: bool = True) -> DataFrame:
        """All four detectors over the same staged joins, judged in one pass."""
        sets = [self.discount_sets(tuned), self.refund_sets(), self.churn_sets(tuned), self.lifecycle_sets(tuned)]
        return ev.scorecard(sets, f1_of_rounded=not tuned)
