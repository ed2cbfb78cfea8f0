"""The operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.llm import (chat, decontaminate, hardnegatives, jaccard, licenses, lm, oracles, pieces, quality, repair, resample,
                           sharding, tokencount, wrappers)
from sheafwork.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, name = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", f"{name}.n_words", f"{name}.word_chars", f"{name}.n_symbols",
                         f"{name}.n_dup_lines", f"{name}.n_repeat_words", f"{name}.base_failed", f"{name}.kept")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(said).alias("text"))
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return chat.read_back(chat.format_conversations(rows.union(probe), *vocabulary), *vocabulary)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


def op5_token_ids_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.through_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.backoff_scores(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether the text decoded from them is the text."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded, ids = pieces.with_ids(table(spark, sf_dir, "documents"), path)
    decoded = encoded.select("doc_id", "text", ids, pieces.piece_text(F.col(ids), path).alias("back"))
    return decoded.select("doc_id", F.size(ids).cast("bigint").alias("n_ids"), F.xxhash64(ids).alias("ids_hash"),
                          F.octet_length("back").cast("bigint").alias("decoded_bytes"),
                          F.col("back").eqNullSafe(F.col("text")).alias("exact"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "source")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id is divisible by 50 ask all rows; every seventh label is moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=moved)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_quality_rules, op2_chat_formatting, op3_token_counts, op4_ngram_jaccard_join, op5_token_ids_repair, op6_lm_scoring,
    op7_sentencepiece, op8_sharding, op9_benchmark_decontamination, op10_license_scans, op11_hard_negatives,
    op12_importance_resampling, op13_html_extraction)}

ORACLES: dict[str, str] = {
    "op1_quality_rules": oracles.QUALITY,
    "op2_chat_formatting": oracles.CHAT,
    "op4_ngram_jaccard_join": oracles.JACCARD,
    "op11_hard_negatives": oracles.HARD_NEGATIVES,
    "op12_importance_resampling": oracles.RESAMPLING,
}
