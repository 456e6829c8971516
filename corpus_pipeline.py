"""A training corpus from `documents`: five stages, each written as Parquet before the next one reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestream.llm import common, decontam, mixing, neardup, quality, substring
from tidestream.sources import checkpoints


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their hosts' verdicts reject go: those of null or blank text too, as they have no words. Each row is
    judged by itself, whatever its doc_id; a null source is a host like others. Columns stay, whatever their names."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by shingles of five words, the smallest doc_id stays, with all its rows. Documents of null or
    blank text are no duplicates of each other. Rows without a doc_id all stay. Columns stay."""
    return neardup.keep_one(docs, size=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that an earlier document holds go, and documents that lose all their words; n_chars follows the text. A text that
    loses nothing stays as it is, null included, and so does one without a doc_id. Columns stay."""
    return substring.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row judged by itself. Null or blank texts hold none, null or blank items are held by
    none. Columns stay."""
    return decontam.without_matches(docs, common.read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, and where in training they stand: a row for each row. A null source is one of its own,
    the last; null or blank texts have size 0. Columns other than doc_id, source and text are not looked at."""
    return mixing.mixed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mixing),
]

#: Near duplicates and edit matches are beyond SQL: tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    folder = f"{common.folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            checkpoints.drop(spark, f"{folder}/{k - 1}")  # no stage reads it any more; the last one's stays, as the result is read from it
    return docs
