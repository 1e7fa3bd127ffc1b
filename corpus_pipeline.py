"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, secrets, pieces.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept.
:func:`run` writes what a stage returns to the shared folder and reads it again for the next.
"""

from basketflow.llm.common import saved
from basketflow.llm.decontamination import decontaminate
from basketflow.llm.pieces import encode_pieces
from basketflow.llm.quality_rules import quality_filter
from basketflow.llm.secret_scan import redact_secrets
from basketflow.llm.simhash import simhash_dedup
from pyspark.sql import DataFrame, SparkSession


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_filter(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash_dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, ``n_chars`` follows its text."""
    return redact_secrets(docs, length_col="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left: ``doc_id, n_tokens, ids, score, round_trip``."""
    return encode_pieces(docs)


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", keep_one_of_each),
    ("benchmark passages", drop_benchmark),
    ("secrets", mask_secrets),
    ("pieces", encode),
]

#: SQL has no XXH64, latent search or piece model; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
