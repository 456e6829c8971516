"""Messages sent to a queue through an outbox: what fails is sent again, and a restart loses nothing.

Each micro-batch first adds its messages to the outbox table, then these and what the round before left go to the transport;
those that it takes are listed as sent, the others are written down as left, for the next round. So a round reads what is new and
what is left, not what has ever been sent. A crash in between sends a message twice rather than never; receivers tell by its key.
Batches of the same number replace each other, so a batch that is run again adds nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidestream.sources import shared

#: A transport takes a key and a message and tells whether it took it; it runs in tasks, so it must be picklable.
Transport = Callable[[str, str], bool]
#: Further tries within one micro-batch, and seconds before the next; failed messages in a row after which a task leaves the rest.
TRIES, PAUSE, FAILURES = 2, 1.0, 5


MESSAGE = "key string, payload string"


class JsonFiles:
    """Writes each message to a file named by its key in a shared folder."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, key: str, message: str) -> bool:
        with shared.create(f"{self.folder}/{key.replace(':', '-').replace('/', '-').replace(' ', 'T')}.json") as f:
            f.write(message.encode())
        return True


def _send(transport: Transport):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = 0
        for batch in batches:
            taken = []
            for key, message in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if failed >= FAILURES:
                    break
                failed += 1
                for again in range(1 + TRIES):
                    if again:
                        time.sleep(PAUSE)
                    try:
                        ok = transport(key, message)
                    except OSError:
                        ok = False
                    if ok:
                        failed = 0
                        taken.append(key)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(taken, pa.string())], names=["key"])

    return run


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def _round(spark: SparkSession, outbox: str, transport: Transport, new: DataFrame | None, before: str | None, mark: str, sent: str) -> None:
    """Sends `new` and what round `before` left; mark names this round, sent its list of sent keys."""
    left = spark.createDataFrame([], MESSAGE) if before is None else _table(spark, f"{outbox}/left/{before}", MESSAGE)
    todo = (left if new is None else left.unionByName(new)).dropDuplicates(["key"])
    todo.mapInArrow(_send(transport), "key string").write.mode("overwrite").parquet(f"{outbox}/sent/{sent}")
    rest = todo.join(spark.read.schema("key string").parquet(f"{outbox}/sent/{sent}"), "key", "left_anti").select("key", "payload")
    rest.write.mode("overwrite").parquet(f"{outbox}/left/{mark}")


def _rounds(outbox: str) -> list[str]:
    """The rounds that are over, in order: a mark is the number of its batch, then a dash and how many came after it."""
    done = [x for x in shared.names(f"{outbox}/left") if shared.exists(f"{outbox}/left/{x}/_SUCCESS")]
    return sorted(done, key=lambda x: tuple(map(int, x.split("-"))))


def send_pending(spark: SparkSession, outbox: str, transport: Transport, mark: str) -> None:
    """Sends what the last round has left, without waiting for a further batch; mark names its list of sent keys. Not while a stream is
    sending to the same outbox."""
    done = _rounds(outbox)
    if done:
        number, _, more = done[-1].partition("-")
        _round(spark, outbox, transport, None, done[-1], f"{number}-{int(more or 0) + 1}", mark)


def published(messages: DataFrame, key: str, outbox: str, transport: Transport, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts sending a stream of messages (key column and `payload`); outbox and checkpoint are shared folders."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.select(F.col(key).cast("string").alias("key"), "payload").write.mode("overwrite").parquet(f"{outbox}/messages/{number}")
        before = [x for x in _rounds(outbox) if int(x.partition("-")[0]) < number]
        _round(spark, outbox, transport, spark.read.schema(MESSAGE).parquet(f"{outbox}/messages/{number}"), before[-1] if before else None, str(number), str(number))
        for old in before[:-1]:
            shared.delete_folder(f"{outbox}/left/{old}")

    writer = messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
