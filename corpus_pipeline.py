"""A corpus pipeline of five stages over ``documents``.

Each stage takes what the one before it kept: documents that the quality model
rejects go, one document of each near-duplicate group stays, documents that
hold test items go, secrets are redacted, and what is left is packed into
training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locuspark.llm import classify, decontaminate, packing, secrets, similar
from locuspark.llm.frames import drop_written, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classify.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.deduplicated(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.without_secrets(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", benchmark_free), ("secrets", redacted), ("packing", sequences)]

#: Models, hashes and packing are beyond SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
