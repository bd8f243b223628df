from __future__ import annotations

from datetime import date

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from marginwatch.operators import facts, metrics, reporting
from marginwatch.plans import run
from marginwatch.sources import files, stage


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "orders.csv").write_text(
        "order_id,customer_id,order_status,order_purchase_timestamp,order_delivered_customer_date\n"
        '"o1","c1","delivered",2018-01-02 03:04:05,2018-01-09 00:00:00\n'
        '"o2","c2","canceled",2018-01-03 03:04:05,\n'
    )
    (tmp_path / "order_payments.csv").write_text("order_id,payment_type,payment_value\no1,card,10.50\no2,card,0\n")
    return str(tmp_path)


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_csv_gets_the_declared_types(spark, folder):
    orders = files.read_csv(spark, f"{folder}/orders.csv", "orders")
    assert dict(orders.dtypes)["order_purchase_timestamp"] == "timestamp_ntz"
    assert orders.filter("order_delivered_customer_date IS NULL").count() == 1
    other = files.read_csv(spark, f"{folder}/order_payments.csv")
    assert dict(other.dtypes)["payment_value"] == "double"


def test_csv_columns_go_by_name_and_malformed_values_to_null(spark, tmp_path):
    (tmp_path / "p.csv").write_text("payment_value,extra,order_id\n1.5,x,o1\nmany,y,o2\n")
    rows = files.read_csv(spark, f"{tmp_path}/p.csv", "order_payments").orderBy("order_id").collect()
    assert [(r.order_id, r.payment_value, r.extra) for r in rows] == [("o1", 1.5, "x"), ("o2", None, "y")]
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_csv(spark, f"{tmp_path}/p.csv", "order_payments", mode="FAILFAST").collect()


def _csv_tables(edge_tables, folder):
    for name, df in edge_tables.items():
        df.toPandas().to_csv(folder / f"{name}.csv", index=False)


def test_malformed_records_are_set_aside_and_counted(spark, edge_tables, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    _csv_tables(edge_tables, source)
    with open(source / "order_payments.csv", "a") as f:
        f.write("a,many\nzz,1.0,surplus\n")
    with open(source / "orders.csv", "a") as f:
        f.write("x,cx,delivered,yesterday,2018-01-01 00:00:00\n")
    clean, bad = files.quarantined(files.read_tables(spark, str(source), corrupt=True))
    assert sorted(map(tuple, bad.collect())) == [
        ("order_payments", "a,many"),
        ("order_payments", "zz,1.0,surplus"),
        ("orders", "x,cx,delivered,yesterday,2018-01-01 00:00:00"),
    ]
    for name, df in edge_tables.items():
        assert clean[name].columns == df.columns and clean[name].count() == df.count()
    before = set((tmp_path / "in").iterdir())
    counts = run.full_run(spark, str(source), str(tmp_path / "out"))
    assert counts["quarantine"] == 3 and set((tmp_path / "in").iterdir()) == before
    notes = spark.read.parquet(str(tmp_path / "out" / "quality")).where("issue = 'malformed records'").collect()
    assert sorted((r.table, r.note.split()[0]) for r in notes) == [("order_payments", "2"), ("orders", "1")]
    want = run.results(edge_tables)["overall"].first()
    assert spark.read.parquet(str(tmp_path / "out" / "overall")).first() == want
    with pytest.raises(Exception, match="MALFORMED"):
        run.full_run(spark, str(source), str(tmp_path / "failed"), mode="FAILFAST")


def test_a_failed_run_leaves_no_table_and_no_staged_folder(spark, edge_tables, tmp_path, monkeypatch):
    for name, df in edge_tables.items():
        df.write.parquet(str(tmp_path / "in" / f"{name}.parquet"))

    def held():
        folder = f"{stage.stage_dir(spark)}/marginwatch-{spark.conf.get('spark.app.id')}"
        return set(os.listdir(folder)) if os.path.isdir(folder) else set()

    def failing(tables, folder, fmt="parquet"):
        assert any(t.name.startswith("marginwatch_") for t in spark.catalog.listTables())
        assert stage.staged(spark.range(3)).count() == 3 and held() - before
        raise RuntimeError("midway")

    before = held()
    monkeypatch.setattr(run, "write_all", failing)
    with pytest.raises(RuntimeError, match="midway"):
        run.full_run(spark, str(tmp_path / "in"), str(tmp_path / "out"), "parquet", buckets=2)
    assert held() == before
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("marginwatch_")]


def test_a_view_loads_the_saved_tables_it_needs(spark, edge_tables, tmp_path):
    files.save_result(edge_tables["sellers"], f"{tmp_path}/risk")
    assert set(files.load_results(spark, str(tmp_path), names=("risk",))) == {"risk"}


def test_tables_views_and_parameters(spark, folder):
    tables = files.read_tables(spark, folder, names=("orders", "order_payments"))
    files.register_tables(tables)
    row = files.run_query(
        spark,
        "SELECT SUM(payment_value) AS v FROM order_payments JOIN orders USING (order_id) WHERE order_status = :s",
        {"s": "delivered"},
    ).first()
    assert row.v == 10.5
    assert files.save_query(spark, "SELECT * FROM orders", f"{folder}/out") == 2
    assert files.save_query(spark, "SELECT * FROM orders LIMIT 1", f"{folder}/out") == 1
    assert spark.read.option("header", True).csv(f"{folder}/out").count() == 1


def test_bucketed_tables_join_without_shuffling_the_large_sides(spark, edge_tables):
    saved = files.save_bucketed(edge_tables, 4, "b_")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        paid = saved["orders"].join(facts.order_payments(saved["order_payments"]), "order_id")
        assert "Exchange" not in paid._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = metrics.overall_kpis(edge_tables["orders"], edge_tables["order_payments"]).first()
    assert metrics.overall_kpis(saved["orders"], saved["order_payments"]).first() == want


def test_bucketed_lines_join_without_shuffling_orders_items_or_payments(spark, edge_tables):
    saved = files.save_bucketed(edge_tables, 4, "c_")
    categories = facts.product_categories(saved["products"], saved["category_xlat"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        lines = facts.category_lines(saved["order_items"], F.broadcast(categories))
        rows = facts.joined_rows(facts.orders_with(saved["orders"], []), lines, saved["order_payments"])
        plan = rows.groupBy("category_en").agg(F.count_distinct("order_id"))._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffled = [line for line in plan.toString().split("\n") if "Exchange hashpartitioning" in line]
    assert not any("order_id" in line or "product_id" in line for line in shuffled), plan.toString()


def test_staging_uses_the_shared_folder(spark):
    named = spark.sparkContext.getConf().get(stage.SETTING)
    assert stage.stage_dir(spark) == named
    df = stage.staged(spark.range(5).withColumn("t", F.expr("TIMESTAMP_NTZ '2018-01-01 00:00:00'")))
    assert df.count() == 5 and named in df.inputFiles()[0]


@pytest.mark.parametrize("buckets", [None, 3])
def test_full_run_writes_and_loads_every_result(spark, edge_tables, tmp_path, buckets):
    counts = run.write_all(run.trial_results(edge_tables, "toys_own", buckets=buckets), str(tmp_path))
    assert counts["eval_df"] == 4 and counts["kpis"] == 1
    loaded = files.load_results(spark, str(tmp_path), trial=True)
    assert set(loaded) == {*files.RESULT_TABLES, "eval_df"}
    assert loaded["monthly"].agg(F.min("year_month")).first()[0] == date(2018, 1, 1)
    # the dashboard's numbers come from the saved tables alone
    served = reporting.summary_kpis(loaded["risk"], loaded["zscore"]).first()
    assert served == spark.read.parquet(f"{tmp_path}/kpis").first()


def test_staging_without_a_shared_folder_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(stage, "setting", lambda _: None)
    monkeypatch.setattr(stage, "_named", {})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stage.stage_dir(spark)


def _clean_env():
    return {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}


def test_command_analyses_the_tables_as_given(edge_tables, tmp_path):
    for name, df in edge_tables.items():
        df.write.parquet(str(tmp_path / "in" / f"{name}.parquet"))
    command = [sys.executable, "-m", "marginwatch.plans.run", str(tmp_path / "in"), str(tmp_path / "out"), "parquet"]
    subprocess.run(command, cwd=ROOT, env=_clean_env(), check=True, timeout=240, capture_output=True)
    assert not (tmp_path / "out" / "labels").exists() and not (tmp_path / "out" / "trial").exists()
    spark = edge_tables["orders"].sparkSession
    overall = spark.read.parquet(str(tmp_path / "out" / "overall")).first()
    want = run.results(edge_tables)["overall"].first()
    assert overall == want


def test_forest_runs_where_the_package_is_not_installed(tmp_path):
    code = (
        "import importlib.util as u; from pyspark.sql import SparkSession\n"
        f"s = u.spec_from_file_location('entry_', {os.path.join(ROOT, '__spark_entry__.py')!r})\n"
        "e = u.module_from_spec(s); s.loader.exec_module(e)\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "assert e.queries()['iforest_top'](spark, '/root/testdata/sf0.001').count() > 0\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=_clean_env(), check=True, timeout=240)


def test_refund_rules_reach_the_detector(spark):
    from marginwatch.plans.analysis import Analysis
    from marginwatch.rules import Rules
    from marginwatch.sources.star import star_tables

    tables = star_tables(spark, "/root/testdata/sf0.001")
    assert Analysis(tables).l2.count() != Analysis(tables, Rules(window_weeks=20, min_weeks=15)).l2.count()
