"""A corpus from documents to packed sequences: language, near-duplicates, personal data, source weights, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lyceum.llm import langid, minhash_dedup, mixing, packing, pii
from lyceum.llm.common import checkpoint_dir
from lyceum.session import prepare, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those that the identifier rejects go."""
    prepare(spark)
    return langid.known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    prepare(spark)
    return minhash_dedup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind."""
    prepare(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the one at a source's budget in part."""
    prepare(spark)
    return mixing.materialised(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mix_sources", mix_sources), ("pack", pack)]

#: Models, tokenizers and hash orders aren't SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written as Parquet to the shared folder and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
