"""The operators as queries over the test tables: ``name -> f(spark, sf_dir)``."""

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketflow.llm import fill_in_middle, ranked_search, repeated_bytes, secret_scan
from basketflow.llm.decontamination import contaminated
from basketflow.llm.pieces import encode_pieces
from basketflow.llm.quality_classifier import quality_scores
from basketflow.llm.quality_rules import quality_verdicts
from basketflow.llm.repeated_bytes import remove_repeated_bytes
from basketflow.llm.sharding import shard_by_bytes
from basketflow.llm.simhash import simhash_groups
from basketflow.llm.suffix_tree import lm_scores
from basketflow.llm.token_counts import section_token_counts
from basketflow.llm.toxicity import toxicity_scores

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(_table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_verdicts(_table(spark, sf_dir, "documents"))
    return verdicts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "distance",
    )


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_token_counts(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(_table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeated_bytes(_table(spark, sf_dir, "documents"))
    return left.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"))


def llm_queries() -> dict[str, Query]:
    """One query for each operator, applied to its whole table, and the pipeline of several."""
    found = [
        op1_lm_scoring, op2_sentencepiece, op3_benchmark_decontamination, op4_toxicity,
        op5_quality_classifier, op6_secret_scans, op7_quality_rules, op8_simhash_near_dedup,
        op9_token_counts, op10_sharding, op11_ranked_search, op12_suffix_array_dedup,
        op13_fill_in_middle,
    ]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def llm_oracles() -> dict[str, str]:
    """SQL for those that SQL can express."""
    return {
        "op6_secret_scans": secret_scan.oracle_sql(),
        "op11_ranked_search": ranked_search.oracle_sql(),
        "op12_suffix_array_dedup": repeated_bytes.oracle_sql(),
        "op13_fill_in_middle": fill_in_middle.oracle_sql(),
    }
