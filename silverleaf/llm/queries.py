"""The registered queries of the text operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, conversation_repair, decontamination, jaccard_join, language_id, near_dedup, quality, quality_rules, sharding, spelling_variants, token_counts, toxicity
from .common import fold_is, read


def encoded(docs: DataFrame) -> DataFrame:
    """Digests of each document's ids and of the text they decode to."""
    rows = bpe.encode_decode(docs)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)
    return rows.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return rows.withColumnRenamed("id", "doc_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = toxicity.predict(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return rows.select(F.col("id").alias("doc_id"), fold_is("id", 3, 1).alias("held_out"), "score", predicted.alias("predicted"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_back(chat_format.examples(turns))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = language_id.predict(docs, language_id.train(docs))
    return rows.select(F.col("id").alias("doc_id"), fold_is("id", 5, 0).alias("held_out"), "lang_pred", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = quality.predict(docs, quality.train(docs, read(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int")
    return rows.select(F.col("id").alias("doc_id"), fold_is("id", 4, 2).alias("held_out"), "score", predicted.alias("predicted"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    ratios = quality_rules.train(docs, read(spark, sf_dir, "labels"))
    return quality_rules.score(docs, ratios).withColumnRenamed("id", "doc_id").withColumn("log_ratio", F.round("log_ratio", 6))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "copies")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired_conversations(read(spark, sf_dir, "conversations"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(spelling_variants.vocabulary(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_decontamination": op2_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_chat_format": op4_chat_format,
    "op5_token_counts": op5_token_counts,
    "op6_language_id": op6_language_id,
    "op7_quality": op7_quality,
    "op8_sharding": op8_sharding,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": decontamination.ORACLE_SQL,
    "op4_chat_format": chat_format.ORACLE_SQL,
    "op8_sharding": sharding.ORACLE_SQL,
    "op9_quality_rules": quality_rules.ORACLE_SQL,
    "op10_simhash_near_dedup": near_dedup.ORACLE_SQL,
    "op11_conversation_repair": conversation_repair.ORACLE_SQL,
    "op12_jaccard_join": jaccard_join.ORACLE_SQL,
    "op13_spelling_variants": spelling_variants.ORACLE_SQL,
}
