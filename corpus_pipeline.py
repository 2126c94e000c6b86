"""Corpus pipeline: language, quality, near duplicates, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; ``run`` writes each stage's result as a
table in the session's shared folder and reads it again for the next. Each stage but the last returns the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm import langid, mixing, piece_codec, quality_rules, simhash_variants
from cellweave.llm.common import keep, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language."""
    return langid.keep_languages(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that break the base rules or their group's limits."""
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component."""
    return simhash_variants.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    return piece_codec.digest_documents(docs)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: Language identification, components and tokens are beyond SQL; a test holds each stage of the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
