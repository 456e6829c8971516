"""The operators' queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestream.llm import audit, chat, decontam, fim, htmltree, langmodel, licences, mixing, neardup, oracles, quality, substring, tokens, warc
from tidestream.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(read(spark, sf_dir, "documents"))
    return rows.withColumn("host_rate", F.round("host_rate", 6))


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it."""
    return decontam.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed_digest(read(spark, sf_dir, "documents"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltree.extracted(read(spark, sf_dir, "pages"))


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    return chat.digests(chat.formatted(turns))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.grouped(read(spark, sf_dir, "documents"))


def warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages"))


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(read(spark, sf_dir, "documents"))
    return rows.withColumns({c: F.round(c, 9) for c in ("first_position", "second_position")})


def licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source and language are their directories."""
    docs = read(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("unknown")), F.lit("/"), F.coalesce("lang", F.lit("unknown")), F.lit("/"), F.col("doc_id").cast("string"))
    return licences.licences(docs.select("doc_id", path.alias("path"), "text"))


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transformed(read(spark, sf_dir, "documents")))


def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.scored(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": quality_rules,
    "op2_decontamination": decontaminate,
    "op3_substring_dedup": substring_dedup,
    "op4_html_extraction": html_extraction,
    "op5_chat_formatting": chat_formatting,
    "op6_token_counts": token_counts,
    "op7_minhash_dedup": near_duplicates,
    "op8_warc": warc_archives,
    "op9_source_mixing": source_mixing,
    "op10_licence_scans": licence_scans,
    "op11_fill_in_middle": fill_in_middle,
    "op12_filter_audit": filter_audit,
    "op13_model_scores": model_scores,
}

ORACLES: dict[str, str] = oracles.ORACLES
