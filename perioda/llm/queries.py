"""Queries of the pipeline operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from perioda.llm import (
    decision_lists,
    decontamination,
    filter_audit,
    jaccard_join,
    line_chunks,
    pfair,
    quotations,
    sharding,
    simhash,
    target_resampling,
    token_counts,
    url_digests,
    wavelet,
)

SHARDS = 16
#: (host, path, verdict) of the url query.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)
    return counted.drop("text")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.assign(table(spark, folder, "documents"), SHARDS, seed=42)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rules = decision_lists.fit(docs, table(spark, folder, "labels"))
    judged = decision_lists.judge(docs.select("doc_id", "text"), rules, out="quality")
    return judged.select("doc_id", "quality.*")


def op5_quotations(spark: SparkSession, folder: str) -> DataFrame:
    """The conversations have no quotes, so they are first laid out as mails that quote two messages each."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return quotations.link(quotations.with_quotes(turns), scope=["conv_id"], order="turn")


def op6_wavelet_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return wavelet.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_digests.judge_urls(pages, url_digests.rules_table(spark, URL_RULES)).drop("url")


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.classes(table(spark, folder, "documents"))
    return found.withColumn("fingerprint", simhash.hex_digits(F.col("fingerprint")))


def op9_line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_chunks.remove_repeated(docs)


def op10_pfair_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return pfair.mix(docs, seed=42)


def op11_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.classes(table(spark, folder, "documents"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_target_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return target_resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_decontamination, op3_sharding, op4_quality_rules, op5_quotations, op6_wavelet_files,
        op7_url_filters, op8_simhash, op9_line_chunks, op10_pfair_mixing, op11_jaccard_join, op12_filter_audit,
        op13_target_resampling,
    )
}
