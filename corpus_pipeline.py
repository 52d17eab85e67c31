"""The corpus pipeline: language ID, near-dedup of 5-word shingles, PII, mixing to target weights, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's result as
Parquet into the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bpe, langid, mixing, pii, queries, resemblance
from tallyforge.llm.common import stage


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows the new text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network names; null texts and texts without letters go."""
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word Jaccard of 0.8 or more): the one with the smallest doc_id. SimHash by
    anchor-point covering finds them, and min-hash bands what lies beyond its reach."""
    return resemblance.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms."""
    return _recounted(pii.pseudonymised(docs, queries.pii_key(spark)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return _recounted(mixing.mixed_documents(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each document of the mix."""
    return bpe.encoded(docs, with_ids=True)


STAGES = [("language", language), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]

#: SQL has no XXH64, network or tokenizer: the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
