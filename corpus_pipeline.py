"""The corpus pipeline: quality rules, exact dedup, near dedup, source mix and BPE tokens, each over what the last one kept.

Each stage is a function of (spark, docs, sf_dir): docs are the rows that the stage before kept, with the columns of
documents; the last stage returns one row per document copy with its tokens' digests. Between stages the rows are
written as Parquet to the shared folder and read again, so a stage that is lost starts from there.

Stage results with nulls, empty and very long texts, ties, repeated rows and empty tables are those that the operators'
docstrings define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treelight.llm import bpe, common, exact_dedup, minhash_dedup, quality_rules, source_mix
from treelight.session import ship

TOKENIZER = "byte_bpe_50k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return exact_dedup.dedup_rows(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least id."""
    ship(spark)
    return minhash_dedup.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: once, twice or not at all; where a quota ends inside one, cut there."""
    return source_mix.mixed_rows(docs, chars_col="n_chars")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    import public_tokenizers

    ship(spark)
    return bpe.encode_table(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("minhash_dedup", near_stage),
    ("source_mix", mix_stage),
    ("bpe", token_stage),
]

#: Near dedup and BPE can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
