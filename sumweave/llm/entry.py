"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, language_id, line_dedup, mixing, near_dedup, quality, sharding, substring_dedup, token_count, url_filter
from .common import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.query(table(spark, sf_dir, "documents"))


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.query(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.query(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.query(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.query(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.query(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dedup, op2_token_count, op3_decontamination, op4_line_dedup, op5_language_id,
        op6_substring_dedup, op7_quality, op8_url_filter, op9_mixing, op10_sharding,
    )
}
ORACLE_SQL = {
    "op1_near_dedup": near_dedup.ORACLE_SQL,
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op6_substring_dedup": substring_dedup.ORACLE_SQL,
    "op7_quality": quality.ORACLE_SQL,
    "op8_url_filter": url_filter.ORACLE_SQL,
    "op10_sharding": sharding.ORACLE_SQL,
}
