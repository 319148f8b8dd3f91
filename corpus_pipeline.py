"""A training-data pipeline over ``documents``: clean, deduplicate, decontaminate, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's rows to
the folder all executors share and the next stage reads them back, so a lost executor repeats at
most a part of one stage. All stages but the last return the columns of ``documents``. A line that
the quality rules remove and a passage that the substring stage removes are gone from ``text``, and
``n_chars`` is counted again where the text has changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votecount.llm import decontaminate, minhash, packing, quality, substring
from votecount.llm.common import saved, shared_folder, table

#: Some stage (near-duplicate groups, packing) is beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
#: Similarity of five-word shingles from which documents are near copies, in percent.
NEAR_PCT = 80


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now; rows whose count was right before keep it."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(quality.keep_clean(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, pct=NEAR_PCT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(substring.drop_repeats(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, "word_bpe_49k.json")


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"{folder}/{i}-{name}")
    return docs
