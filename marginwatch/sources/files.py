"""Reading source tables, registering them, and writing results."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from marginwatch.functions.timekeys import month_start
from marginwatch.sources.schemas import CORE_TABLES, SCHEMAS
from marginwatch.sources.stage import staged

Tables = dict[str, DataFrame]


# Text of a malformed record, in the column that :func:`read_csv` adds on request.
CORRUPT = "_corrupt_record"


def read_csv(
    spark: SparkSession, path: str, table: str | None = None, mode: str = "PERMISSIVE", corrupt: bool = False
) -> DataFrame:
    """CSV with a header. A known table gets its declared schema, others are inferred.

    The file's header decides which declared columns exist, so a file holding only
    some of them, or holding them in another order, still loads by name; columns
    that are not declared stay text. A malformed value becomes null; with ``corrupt`` the
    column ``_corrupt_record`` holds the whole record then and null otherwise, see :func:`quarantined`.
    ``mode`` FAILFAST ends the load instead. Review texts span lines, so that table is read with
    quoted newlines allowed.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    if table not in SCHEMAS:
        return reader.option("inferSchema", True).csv(path)
    if table == "order_reviews":
        reader = reader.option("multiLine", True)
    kinds = {field.name: field.dataType for field in SCHEMAS[table].fields}
    # Without inference this reads the header only.
    header = reader.csv(path).columns
    schema = StructType([StructField(c, kinds.get(c, StringType())) for c in header])
    if corrupt:
        schema = schema.add(CORRUPT, StringType())
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(schema).option("mode", mode).csv(path)


def read_tables(
    spark: SparkSession,
    base: str,
    fmt: str = "csv",
    files: Mapping[str, str] | None = None,
    names: Iterable[str] = CORE_TABLES,
    mode: str = "PERMISSIVE",
    corrupt: bool = False,
) -> Tables:
    """Named tables below ``base``; ``files`` overrides the default ``<table>.<fmt>``.

    ``mode`` and ``corrupt`` are those of :func:`read_csv`.
    """
    files = files or {}
    tables = {}
    for name in names:
        path = f"{base}/{files.get(name, f'{name}.{fmt}')}"
        if fmt == "csv":
            tables[name] = read_csv(spark, path, name, mode, corrupt)
        else:
            tables[name] = spark.read.format(fmt).load(path)
    return tables


def quarantined(tables: Tables) -> tuple[Tables, DataFrame | None]:
    """``tables`` without malformed records, and those records as (table, record).

    The tables are those of :func:`read_tables` with ``corrupt``; without such a column a table stays
    as it is, and None stands for the records if no table has one. A record with one malformed value
    leaves its table whole, so no figure counts half of it. Each table is parsed once, with all its
    columns, and staged: a reader of text files that drops columns would not see what is wrong in them.
    """
    clean, bad = {}, None
    for name, df in tables.items():
        if CORRUPT not in df.columns:
            clean[name] = df
            continue
        held = staged(df)
        clean[name] = held.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
        rows = held.where(F.col(CORRUPT).isNotNull()).select(F.lit(name).alias("table"), F.col(CORRUPT).alias("record"))
        bad = rows if bad is None else bad.union(rows)
    return clean, bad


def register_tables(tables: Tables, prefix: str = "") -> None:
    """Temporary views under the prefixed table names, replacing earlier ones."""
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")


@contextmanager
def bucketed_scope(spark: SparkSession, prefix: str) -> Iterator[str]:
    """Drops every managed table whose name starts with ``prefix`` at the end, also after a failure."""
    try:
        yield prefix
    finally:
        for table in spark.catalog.listTables(pattern=f"{prefix}*"):
            if not table.isTemporary:
                spark.sql(f"DROP TABLE IF EXISTS `{table.name}`")


def save_bucketed(tables: Tables, buckets: int, prefix: str = "") -> Tables:
    """Managed tables with the three large ones bucketed and sorted by order_id.

    Joins and groupings on order_id then read co-located buckets and skip their
    shuffles. At scale pick the bucket count so that one bucket of items fits a task.
    """
    saved = {}
    for name, df in tables.items():
        target = f"{prefix}{name}"
        writer = df.write.mode("overwrite").format("parquet")
        if name in ("orders", "order_items", "order_payments"):
            writer = writer.bucketBy(buckets, "order_id").sortBy("order_id")
        writer.saveAsTable(target)
        saved[name] = df.sparkSession.table(target)
    return saved


def run_query(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """SQL text over the registered tables, with named parameters."""
    return spark.sql(sql, args=args or {})


def save_result(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Overwrite ``path`` and return the row count, counted during the write itself."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return seen.get["rows"]


def save_query(spark: SparkSession, sql: str, path: str, fmt: str = "csv") -> int:
    return save_result(run_query(spark, sql), path, fmt)


# Result tables of a full run, as the reporting views name them.
RESULT_TABLES = (
    "baseline",
    "zscore",
    "l1",
    "l2",
    "l3",
    "l4",
    "rca",
    "monthly",
    "category",
    "cat_weekly",
    "tiers",
    "risk",
)


def load_results(
    spark: SparkSession, base: str, fmt: str = "parquet", trial: bool = False, names: Iterable[str] = RESULT_TABLES
) -> Tables:
    """The saved result tables, with the month key parsed to a date; those of a trial have scores too.

    ``names`` picks the tables that a view needs.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", True)
    results = {name: reader.load(f"{base}/{name}") for name in (*names, *(("eval_df",) if trial else ()))}
    if "monthly" in results:
        month = F.col("year_month").cast("string").substr(1, 7)
        results["monthly"] = results["monthly"].withColumn("year_month", month_start(month))
    return results
