"""From raw documents to token ids: five stages, each over all its predecessor kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marginwatch.llm import bpe, decontamination, near_dedup, secret_scan, toxicity
from marginwatch.llm.common import read
from marginwatch.sources.stage import stage_dir


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the model learns from the labels of the corpus."""
    return toxicity.reject_toxic(docs, read(spark, sf_dir, "labels"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays,
    that with the smallest id."""
    return near_dedup.keep_one(docs, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    return secret_scan.redact(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, ids: the text's token ids in its place."""
    return bpe.encode(docs, bpe.read_ranks(public_tokenizers.path(bpe.DEFAULT)))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", keep_one_copy),
    ("decontamination", drop_benchmark),
    ("secrets", mask_secrets),
    ("tokens", tokenise),
]

# No SQL for learnt models, edit distance and BPE; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    folder = f"{stage_dir(spark)}/corpus-{spark.conf.get('spark.app.id')}-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
