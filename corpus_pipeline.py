"""The corpus pipeline: documents through quality, near-duplicate, benchmark, privacy and mixing stages.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Defined cases, besides those of the operators: null and blank texts are kept by every
filter, as one group of near duplicates, and never mixed in; rows that share an id are
judged one by one, by their texts, and mixed alike; of equal rows one stays; a text that is benchmark
passages only goes; empty tables give an empty result; further columns come along as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zonewise.llm import decontaminate, importance, mixing, pii, simhash
from zonewise.llm.common import read
from zonewise.runtime import drop_folder, scratch, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects (as many as it doesn't reject); the others go."""
    return importance.select(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the least doc_id, nulls last."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents lose their benchmark passages; the others stay as they are."""
    return decontaminate.remove_spans(docs, read(spark, sf_dir, "benchmark"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their copies and training positions, in training order."""
    return mixing.apply_mix(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("privacy", privacy), ("mix", mix)]

#: SQL can't express these stages (hashed models, xxHash fingerprints, a trained field); tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from documents. What lies between them is in the shared folder, and deleted once the next stage is written."""
    docs = read(spark, sf_dir, "documents")
    folder, before = shared_folder(spark), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
