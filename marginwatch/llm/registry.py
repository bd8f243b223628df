"""Queries over the text tables: one per operator, over its whole table, and the pipeline."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from marginwatch.llm import (
    bpe,
    collocations,
    decontamination,
    interpolation,
    lexical_search,
    multi_index,
    near_dedup,
    quality,
    resharding,
    secret_scan,
    token_counts,
    toxicity,
    training_order,
)
from marginwatch.llm.common import read, staged
from marginwatch.sources.stage import stage_dir

Query = Callable[[SparkSession, str], DataFrame]

SHARDS, OLD_SHARDS = 8, 5


def _ranks() -> bytes:
    return bpe.read_ranks(public_tokenizers.path(bpe.DEFAULT))


def op1_toxicity(spark: SparkSession, base: str) -> DataFrame:
    return toxicity.toxicity(read(spark, base, "documents"), read(spark, base, "labels"))


def op2_resharding(spark: SparkSession, base: str) -> DataFrame:
    """The present layout has five shards by text hash, the new one eight of equal bytes.

    Changed shards are written to the shared folder, and size and CRC come from these files; rows of
    a shard that nothing leaves or enters stay where they are in ``documents``.
    """
    old = F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit("old")), F.lit(OLD_SHARDS)).cast("int")
    placed = resharding.reshard(
        read(spark, base, "documents"), SHARDS, old_shard=old, old_shards=OLD_SHARDS, whole=True
    ).select("row", "old_shard", "shard", "slot")
    path = f"{stage_dir(spark)}/shards-{spark.conf.get('spark.app.id')}-{uuid.uuid4().hex}"
    changed = resharding.rewrite(placed, path, apart=True)
    kept = placed.where(~F.col("shard").isin(changed)).select("row", "slot", "shard")
    kind = placed.drop("old_shard", "shard").schema.add("shard", "integer")
    found = spark.read.schema(kind).parquet(path) if changed else kept
    if len(changed) < SHARDS:
        found = found.union(kept) if changed else kept
    text = F.coalesce("text", F.lit(""))
    return found.select("row.*", F.col("slot").alias("_slot"), F.col("shard").alias("_shard")).select(
        "doc_id",
        resharding.text_size().alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        old.alias("old_shard"),
    )


def op6_quality(spark: SparkSession, base: str) -> DataFrame:
    return quality.quality(read(spark, base, "documents"), read(spark, base, "labels"))


def op8_bpe(spark: SparkSession, base: str) -> DataFrame:
    docs = read(spark, base, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, _ranks(), decoded=True))


def op3_near_vectors(spark: SparkSession, base: str) -> DataFrame:
    return multi_index.near_vectors(read(spark, base, "embeddings"))


def op4_token_counts(spark: SparkSession, base: str) -> DataFrame:
    """Token counts of every text before and after three edits derived from it, by its kept tree."""
    docs = read(spark, base, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    trees = staged(token_counts.build_trees(docs, _ranks()))
    after = token_counts.update(trees.withColumn("edits", token_counts.derived_edits()), _ranks())
    return after.select("doc_id", *token_counts.COUNTS)


def op5_training_order(spark: SparkSession, base: str) -> DataFrame:
    """Every record, read back from the fixed-stride shards written to the shared folder."""
    path = f"{stage_dir(spark)}/order-{spark.conf.get('spark.app.id')}-{uuid.uuid4().hex}"
    training_order.write(training_order.materialise(read(spark, base, "documents"), _ranks()), path)
    return training_order.read_records(spark, path)


def op7_secret_scan(spark: SparkSession, base: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(read(spark, base, "documents")))


def op9_near_dedup(spark: SparkSession, base: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, base, "documents"))


def op10_decontamination(spark: SparkSession, base: str) -> DataFrame:
    return decontamination.find_items(read(spark, base, "documents"), read(spark, base, "benchmark"))


def op11_lexical_search(spark: SparkSession, base: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    index = lexical_search.build_index(read(spark, base, "documents"))
    return lexical_search.digests(lexical_search.search(index, read(spark, base, "benchmark")))


def op12_lm_scores(spark: SparkSession, base: str) -> DataFrame:
    return interpolation.lm_scores(read(spark, base, "documents"))


def op13_collocations(spark: SparkSession, base: str) -> DataFrame:
    return collocations.collocations(read(spark, base, "documents"))


def pipeline(spark: SparkSession, base: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, base)


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_resharding": op2_resharding,
        "op3_near_vectors": op3_near_vectors,
        "op4_token_counts": op4_token_counts,
        "op5_training_order": op5_training_order,
        "op6_quality": op6_quality,
        "op7_secret_scan": op7_secret_scan,
        "op8_bpe": op8_bpe,
        "op9_near_dedup": op9_near_dedup,
        "op10_decontamination": op10_decontamination,
        "op11_lexical_search": op11_lexical_search,
        "op12_lm_scores": op12_lm_scores,
        "op13_collocations": op13_collocations,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {}
