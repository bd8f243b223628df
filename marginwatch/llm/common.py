"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from marginwatch.sources.stage import stage_dir, staged

__all__ = ["held_out", "labelled", "map_batches", "read", "staged", "staged_buckets"]


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def staged_buckets(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """:func:`staged`, in buckets of ``key``: groupings and joins by it read the files without a shuffle.

    Nothing is shuffled to write them either, so a task writes as many files as its rows have buckets;
    it suits keys that lie together. The table's entry goes at once, its files stay in the folder.
    """
    spark, name = df.sparkSession, f"staged_{uuid.uuid4().hex}"
    path = f"{stage_dir(spark)}/marginwatch-{spark.conf.get('spark.app.id')}/{name}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of the ids whose labels no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(text, y) of the documents with a label outside the held-out third.

    At most about ``max_rows`` labels are used: above that, those with the smallest hashes of
    their ids. That bound is what makes the broadcast of ids safe. Ids labelled twice count as 1
    if either label is 1; null labels and null ids are left out.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    n = known.count()
    if n > max_rows:
        place = F.pmod(F.xxhash64(F.lit("labelled"), "doc_id"), F.lit(1 << 30))
        known = known.where(place < int((1 << 30) * max_rows / n))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(F.broadcast(known), "doc_id").select("text", "y")


def map_batches(
    df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], Iterable[dict] | dict]]
) -> DataFrame:
    """``mapInArrow`` with state that lives as long as a task.

    ``make`` runs once per task and returns the function applied to every batch, which gives one
    dict of columns, or an iterable of them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            found = each(batch)
            for columns in [found] if isinstance(found, dict) else found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], type=f.type) for f in target], schema=target
                )
        last = getattr(each, "finish", None)
        if last is not None:
            for columns in last():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], type=f.type) for f in target], schema=target
                )

    return df.mapInArrow(run, kind)
