"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votecount.llm import (
    decontaminate,
    langid,
    minhash,
    packing,
    quality,
    substring,
    tokens,
    topk,
    toxicity,
    urls,
    variants,
    warc,
    whitening,
)
from votecount.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.verdicts(table(spark, folder, "documents"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.learn_and_identify(table(spark, folder, "documents"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(table(spark, folder, "documents"), "byte_bpe_50k.json")


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.report(table(spark, folder, "documents"))


def op6_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), urls.rule_table(spark))


def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.verdicts(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_and_read(table(spark, folder, "pages"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), "word_bpe_49k.json")


def op10_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.groups(table(spark, folder, "documents"))


def op11_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), asks=F.col("vec_id") % 50 == 0)


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants(table(spark, folder, "documents"))


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_toxicity,
        op3_language_id,
        op4_token_counts,
        op5_substring_dedup,
        op6_url_filters,
        op7_benchmark_decontamination,
        op8_warc,
        op9_packing,
        op10_minhash_near_dedup,
        op11_exact_top_k,
        op12_spelling_variants,
        op13_embedding_whitening,
    )
}

ORACLE: dict[str, str] = {
    "op1_quality_rules": quality.SQL,
    "op6_url_filters": urls.SQL,
    "op7_benchmark_decontamination": decontaminate.SQL,
    "op8_warc": warc.SQL,
    "op10_minhash_near_dedup": minhash.SQL,
    "op11_exact_top_k": topk.SQL,
    "op12_spelling_variants": variants.SQL,
}
