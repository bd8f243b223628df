"""A full run: source tables in, every result table out.

    python -m marginwatch.plans.run <input folder> <output folder> [csv|parquet] [buckets] [--trial] [--failfast]

The tables are analysed as they are. ``--trial`` also plants labelled leakage in a copy of them, and
writes what the detectors make of that copy, with scores, to the folder ``trial`` of the output.
With a bucket count the large tables are first laid out by order id. That is one shuffle
of each; the dozen results that join or group them by order id then need none.
Malformed CSV records are set aside in ``quarantine`` and counted in the quality report; with
``--failfast`` they end the run. Bucketed tables and staged folders go when the run ends or fails.
"""

from __future__ import annotations

import sys
import uuid
from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession

from marginwatch.operators.quality import quality_report
from marginwatch.plans.analysis import Analysis, Trial
from marginwatch.rules import RULES, Rules
from marginwatch.sources.files import bucketed_scope, quarantined, read_tables, save_bucketed, save_result
from marginwatch.sources.stage import setting, staged, staging_scope, use_temporary_stage_dir

Tables = dict[str, DataFrame]

# Fixed value: the category whose orders the planted refund spike cancels.
SPIKE_CATEGORY = "cama_mesa_banho"


def results(tables: Tables, rules: Rules = RULES, analysis: Analysis | None = None) -> Tables:
    """Result tables by name, for the tables as they are."""
    a = analysis or Analysis(tables, rules, shared=True)
    return {
        "quality": a.dq_report,
        "overall": a.overall_kpis,
        "monthly": a.monthly_revenue,
        "refund_rate": a.monthly_refund_rate,
        "discount_depth": a.discount_depth,
        "category": a.top_categories,
        "weekly": a.weekly_revenue,
        "cat_weekly": a.category_weekly,
        "geo_weekly": a.geo_weekly,
        "customer_ltv": a.customer_tiers,
        "tiers": a.tier_summary,
        "baseline": a.staged_baseline,
        "anomaly_summary": a.anomaly_summary,
        "zscore": a.staged_zscore,
        "forest": a.staged_scores,
        "high_confidence": a.high_confidence,
        "l1": a.l1,
        "l2": a.l2,
        "l3": a.l3,
        "l4": a.l4_flags,
        "risk": a.detector_totals,
        "rca": a.rca_report,
        "kpis": a.summary_kpis,
    }


def trial_results(
    raw: Tables,
    category: str = SPIKE_CATEGORY,
    rules: Rules = RULES,
    buckets: int | None = None,
    prefix: str | None = None,
) -> Tables:
    """All results on tables with planted leakage, plus labels and scores.

    With ``buckets`` the tables are saved under names that start with ``prefix``; the caller drops them.
    """
    prefix = prefix or f"marginwatch_{uuid.uuid4().hex}_"
    if buckets:
        raw = save_bucketed(raw, buckets, f"{prefix}raw_")
    trial = Trial(raw, category, rules)
    changed = {name: trial.planted[name] for name in ("orders", "order_payments")}
    if buckets:
        changed = save_bucketed(changed, buckets, f"{prefix}planted_")
    else:
        changed = {name: staged(df) for name, df in changed.items()}
    planted = {**trial.planted, **changed}
    trial.use(planted, shared=True)
    return {
        **results(planted, rules, trial.analysis),
        "labels": trial.labels,
        "truth": trial.truth,
        "eval_weekly": trial.eval_zscore.unionByName(trial.eval_forest),
        "eval_first": trial.scorecard(tuned=False),
        "eval_df": trial.scorecard(),
    }


def write_all(tables: Tables, folder: str, fmt: str = "parquet") -> dict[str, int]:
    """Each table below ``folder`` under its name; returns the row counts."""
    return {name: save_result(df, f"{folder}/{name}", fmt) for name, df in tables.items()}


def full_run(
    spark: SparkSession,
    source: str,
    target: str,
    fmt: str = "csv",
    buckets: int | None = None,
    trial: bool = False,
    mode: str = "PERMISSIVE",
) -> dict[str, int]:
    """Row counts of all results, written below ``target``. Leaves no table or staged folder behind."""
    prefix = f"marginwatch_{uuid.uuid4().hex}_"
    with ExitStack() as scopes:
        scopes.enter_context(staging_scope(spark))
        scopes.enter_context(bucketed_scope(spark, prefix))
        given, corrupt = quarantined(read_tables(spark, source, fmt, mode=mode, corrupt=fmt == "csv" and mode == "PERMISSIVE"))
        tables = save_bucketed(given, buckets, prefix) if buckets else given
        found, counts = results(tables), {}
        if corrupt is not None:
            counts["quarantine"] = save_result(corrupt, f"{target}/quarantine")
            corrupt = spark.read.schema(corrupt.schema).parquet(f"{target}/quarantine")
            found["quality"] = quality_report(tables["orders"], tables["order_items"], tables["order_payments"], corrupt)
        counts |= write_all(found, target)
        if trial:
            planted = write_all(trial_results(given, buckets=buckets, prefix=prefix), f"{target}/trial")
            counts |= {f"trial/{name}": rows for name, rows in planted.items()}
    return counts


def main(argv: list[str]) -> None:
    flags = {"--trial", "--failfast"}
    source, target, *rest = [a for a in argv if a not in flags]
    fmt = rest[0] if rest else "csv"
    buckets = int(rest[1]) if len(rest) > 1 else None
    spark = SparkSession.builder.appName("marginwatch").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if not setting(spark) and spark.conf.get("spark.master", "").startswith("local["):
        use_temporary_stage_dir()
    mode = "FAILFAST" if "--failfast" in argv else "PERMISSIVE"
    for name, rows in full_run(spark, source, target, fmt, buckets, "--trial" in argv, mode).items():
        print(f"{name:26s} {rows:>12,}")


if __name__ == "__main__":
    main(sys.argv[1:])
