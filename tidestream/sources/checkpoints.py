"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of spark.checkpoint.dir. Only a local session, as in tests, may go without: it gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        set_ = context.getConf().get("spark.checkpoint.dir")
        if not set_ and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(set_ or f"file://{tempfile.mkdtemp(prefix='tidestream-checkpoint-')}")
    return context.getCheckpointDir()


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whichever store Spark has it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """The rows of df, written once: whatever reads them again doesn't make them again."""
    folder(df.sparkSession)
    return df.checkpoint(eager)
