"""The thin queries op1 to op10 and the pipeline, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_paths, langid, mixing, mtree, piece_codec, pitman_yor, qda, quality_rules, simhash_variants, toxicity
from .common import table


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digest_documents(table(spark, sf_dir, "documents"))


def op4_html_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extract_pages(table(spark, sf_dir, "pages"))


def op5_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_variants.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pitman_yor, op2_quality_rules, op3_piece_codec, op4_html_paths, op5_mtree, op6_simhash, op7_mixing, op8_langid, op9_toxicity, op10_qda)}
ORACLE_SQL: dict[str, str] = {"op2_quality_rules": quality_rules.SQL, "op5_mtree": mtree.SQL, "op7_mixing": mixing.SQL}
