"""The digest queries of the llm operators, each over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, features, language, lzprint, neardup, packing, passages, quality, sharding, toxicity
from .store import table


def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = features.held_out("doc_id", 3, 1)
    weights = toxicity.train_toxicity(docs.filter(~held), table(spark, sf_dir, "labels").filter(~held))
    scored = toxicity.score_toxicity(docs, weights)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_lempel_ziv_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.fingerprint_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op5_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


def op6_incremental_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    out = chat.format_conversations(rows.unionByName(extra))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op7_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = features.held_out("doc_id", 5, 0)
    weights = quality.train_quality(docs.filter(~held), table(spark, sf_dir, "labels").filter(~held))
    scored = quality.score_quality(docs, weights)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.shuffle_to_shards(slim)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = features.held_out("doc_id", 3, 1)
    profiles = language.learn_profiles(docs.filter(~held))
    found = language.predict_language(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def vocabulary() -> tuple[str, str]:
    """Ranks file and splitting pattern of the public byte-level BPE vocabulary."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op10_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary())


def queries() -> dict:
    return {f.__name__: f for f in (op1_nnpu_toxicity, op2_collinear_chaining, op3_lempel_ziv_fingerprint, op4_cgk_decontamination, op5_circulant_minhash, op6_incremental_chat, op7_ftrl_quality, op8_hypergeometric_shards, op9_rank_order_language, op10_concatenate_and_cut)}


def oracle_sql() -> dict[str, str]:
    return {}
