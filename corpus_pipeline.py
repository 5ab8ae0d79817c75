"""From documents to a training corpus: five stages, each one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from perioda.llm import decision_lists, decontamination, near_copies, pfair, sharding
from perioda.session import written

SEED, SHARDS = 42, 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rules learned from the labels; rejected documents go."""
    rules = decision_lists.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return decision_lists.keep_good(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, Jaccard 0.8 or more) stays, that with the smallest id."""
    return near_copies.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a test item go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; every document at least once, in the order of the mix."""
    return pfair.ordered(pfair.mix(docs, seed=SEED)).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in random order, in shards whose sizes differ by one at most."""
    return sharding.shard_rows(docs, SHARDS, seed=SEED)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mixing", mixing),
    ("shards", shards),
]

#: SQL has neither the learned rules nor the hashes; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
