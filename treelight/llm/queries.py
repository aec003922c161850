"""Queries over the whole tables, one per operator, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treelight.llm import (
    bpe,
    exact_dedup,
    html_extract,
    language_id,
    license_scan,
    minhash_dedup,
    oracles,
    quality_rules,
    secret_scan,
    source_mix,
    toxicity,
)
from treelight.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents")).drop("source", "shard", "shard_quota")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    "op7_html_extract": op7_html_extract,
    "op6_toxicity": op6_toxicity,
    "op5_language_id": op5_language_id,
    "op8_license_scan": op8_license_scan,
    "op3_secret_scan": op3_secret_scan,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op9_bpe": op9_bpe,
    "op10_source_mix": op10_source_mix,
}

ORACLES = {
    "op1_exact_dedup": oracles.EXACT_DEDUP,
    "op2_quality_rules": oracles.quality(),
    "op8_license_scan": oracles.licenses(),
}
