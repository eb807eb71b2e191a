"""One thin query for each operator: whole tables, production parameters, the agreed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op9_quality_rules import query

    return query(spark, table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op10_sharding import query

    return query(spark, table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op8_mixing import query

    return query(spark, table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op4_chat import query

    return query(spark, table(spark, sf_dir, "conversations"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op3_line_dedup import query

    return query(spark, table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op2_packing import query

    return query(spark, table(spark, sf_dir, "documents"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op1_ngram_join import query

    return query(spark, table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op7_embedding_dedup import query

    return query(spark, table(spark, sf_dir, "embeddings"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op5_html import query

    return query(spark, table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op6_quality_classifier import query

    return query(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
