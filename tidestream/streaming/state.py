"""The state of streaming operators: where it is kept, and reading it from a checkpoint as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def on_rocks(spark: SparkSession) -> None:
    """Streams that are started from now on keep their state in RocksDB, which operators with several kinds of state ask for. A stream that goes on from
    a checkpoint stays with what it began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def operators(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The stateful operators of a query: their ids and names, partitions, and batches of which state is there."""
    return spark.read.format("state-metadata").load(checkpoint)


def table(spark: SparkSession, checkpoint: str, name: str | None = None, operator: int = 0, batch: int | None = None) -> DataFrame:
    """The state of a query after a batch (its last one), without running it: key, value and partition_id. name: which of an operator's states, if it
    has several; lists and maps come entry by entry."""
    found = spark.read.format("statestore").option("operatorId", operator)
    if name is not None:
        found = found.option("stateVarName", name)
    if batch is not None:
        found = found.option("batchId", batch)
    return found.load(checkpoint)
