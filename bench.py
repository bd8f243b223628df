"""Wall seconds of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (data directory), BENCH_CPUS (local cores), BENCH_QUERIES
(comma-separated subset).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from marginwatch.operators import reporting  # noqa: E402
from marginwatch.plans.registry import queries  # noqa: E402
from marginwatch.sources.files import load_results, save_result  # noqa: E402

HEADLINE = (
    "dq_report overall_kpis monthly_revenue monthly_refund_rate discount_depth top_categories weekly_revenue_wow "
    "category_weekly geo_weekly customer_ltv_tier tier_summary rolling_baseline anomaly_summary zscore_anomalies "
    "iforest_scores high_confidence l1_discount_30 l2_refund_spike l3_churn_90 l4_short_orders l4_seller_category "
    "revenue_at_risk truth_category_weeks eval_zscore scorecard rca_state rca_seller rca_tier rca_report exec_kpis "
    "zscore_heatmap"
).split()


def serving_seconds(spark: SparkSession, registered: dict, base: str) -> float:
    """Seconds for the headline numbers from saved result tables, as a dashboard asks for them."""
    folder = tempfile.mkdtemp(prefix="bench-saved-")
    for name, query in (("risk", "detector_totals"), ("zscore", "zscore_anomalies")):
        save_result(registered[query](spark, base), f"{folder}/{name}")
    loaded = {}

    def ask() -> float:
        started = time.perf_counter()
        loaded.update(load_results(spark, folder, names=("risk", "zscore")))
        reporting.summary_kpis(loaded["risk"], loaded["zscore"]).collect()
        return time.perf_counter() - started

    ask()
    return round(min(ask() for _ in range(3)), 3)


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    # One throw-away query, so that the first measured one does not pay for JVM start-up.
    registered = queries()
    registered["weekly_revenue_wow"](spark, base).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in chosen:
        started = time.perf_counter()
        registered[name](spark, base).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "saved_kpis_sec": serving_seconds(spark, registered, base) if "exec_kpis" in chosen else None,
                "sf": os.path.basename(base.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
