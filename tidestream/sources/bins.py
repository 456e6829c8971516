"""Ten-minute containers: name length (2 bytes, little endian), name, payload length (4 bytes), payload, again and again.

Containers are read in ranges: one pass over their headers, file by file in tasks, finds where records begin, and a data source reads some megabytes of
records in each of its tasks, of those bins alone that a filter asks for. Names in a container are data and are never taken as paths. Writing, of a table or a stream,
goes through the same data source, whose tasks write into a folder of the job that a commit makes appear (see `commits`).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidestream.functions import scalars
from tidestream.sources import checkpoints, commits, shared

#: Bytes of records that a task reads, files whose headers a task passes over (more where there are many), tasks from which on small ranges share one.
RANGE_BYTES, FILES_PER_TASK, MANY_FILES, TASKS = 64 << 20, 16, 1024, 256
#: Bytes that could be read while a file is opened: ranges weigh so much more when they are dealt to tasks.
OPEN_BYTES = 64 << 10
#: Bytes of records that a task passes on at once, about, and the most records.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1024
SCHEMA = "bin string, filename string, payload binary"


def frames(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, payload) of each record; an empty name or a torn record ends it."""
    at, view = 0, memoryview(data)
    while at + 2 <= len(view):
        n = int.from_bytes(view[at : at + 2], "little")
        body = at + 2 + n + 4
        if not n or body > len(view):
            return
        size = int.from_bytes(view[body - 4 : body], "little")
        if body + size > len(view):
            return
        yield bytes(view[at + 2 : at + 2 + n]).decode(), bytes(view[body : body + size])
        at = body + size


def framed(name: str, payload: bytes) -> bytes:
    encoded = name.encode()
    return len(encoded).to_bytes(2, "little") + encoded + len(payload).to_bytes(4, "little") + payload


def _rows(batches):
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for name, payload in frames(content.as_buffer()):
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([payload], pa.binary())], names=["bin", "filename", "payload"])


# --- reading in ranges -------------------------------------------------------------------------------------------


def boundaries(file, size: int, most: int = RANGE_BYTES) -> Iterator[tuple[int, int, int]]:
    """(begin, end, records) of stretches of whole records of an open container, about `most` bytes each, from its headers alone."""
    at = begin = n = 0
    while at + 2 <= size:
        file.seek(at)
        name = int.from_bytes(file.read(2), "little")
        body = at + 2 + name + 4
        if not name or body > size:
            break
        file.seek(body - 4)
        end = body + int.from_bytes(file.read(4), "little")
        if end > size:
            break
        at, n = end, n + 1
        if at - begin >= most:
            yield begin, at, n
            begin, n = at, 0
    if n:
        yield begin, at, n


def _boundaries(frames_: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    for frame in frames_:
        found = []
        for path, size in zip(frame["path"], frame["length"], strict=True):
            with shared.opened(path) as file:
                found += [(path, *x) for x in boundaries(file, int(size), most)]
        yield pd.DataFrame(found, columns=["bin", "begin", "end", "records"])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)


def ranges(spark: SparkSession, path: str, most: int = RANGE_BYTES) -> DataFrame:
    """bin (its URI), begin, end, records: stretches of records of the containers under path. Payloads are not read."""
    listed = _files(spark, path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "length")
    files = listed.count()
    n = max(1, min(TASKS // 4, -(-files // FILES_PER_TASK)), -(-files // MANY_FILES))
    return listed.repartition(n, "path").mapInPandas(lambda it: _boundaries(it, most), "bin string, begin long, end long, records long")


def read(spark: SparkSession, path: str, most: int = RANGE_BYTES) -> DataFrame:
    """bin (its path), filename, payload of each record of the containers under path (a folder, a file, or a pattern).

    A filter on bin (equality, a list, comparison, the beginning, end or a part of it) leaves out other bins before any task reads them: their names sort by
    time. Of a store that only Spark reads, files are taken whole."""
    if not all(shared.is_known(r.path) for r in _files(spark, path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path")).limit(1).collect()):
        return _files(spark, path).select("path", "content").mapInArrow(_rows, SCHEMA)
    found = sorted(tuple(r) for r in ranges(spark, path, most).select("bin", "begin", "end").collect())  # one row for each `most` bytes, as of any scan's splits
    plan = f"{shared.qualified(spark, checkpoints.folder(spark))}/bins-{uuid.uuid4().hex}.json"
    with shared.create(plan) as out:
        out.write(json.dumps(found).encode())
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BinFrames)
    return spark.read.format("binframes").option("ranges", plan).load()


@dataclass
class _Ranges(D.InputPartition):
    """What a task reads: path, begin and end of stretches of records."""

    ranges: list[tuple[str, int, int]]


def packed(found: list[tuple[str, int, int]]) -> list[_Ranges]:
    """Ranges dealt to tasks in their order: one each while they are few, else neighbours together, up to RANGE_BYTES with what their opening costs."""
    weight = lambda r: r[2] - r[1] + OPEN_BYTES
    most = min(RANGE_BYTES, sum(map(weight, found)) // TASKS)
    tasks: list[_Ranges] = []
    room = 0
    for r in found:
        if not tasks or weight(r) > room:
            tasks.append(_Ranges([]))
            room = max(most, weight(r))
        tasks[-1].ranges.append(r)
        room -= weight(r)
    return tasks


_TESTS = {
    D.EqualTo: lambda f, x: x == f.value,
    D.In: lambda f, x: x in f.value,
    D.GreaterThan: lambda f, x: x > f.value,
    D.GreaterThanOrEqual: lambda f, x: x >= f.value,
    D.LessThan: lambda f, x: x < f.value,
    D.LessThanOrEqual: lambda f, x: x <= f.value,
    D.StringStartsWith: lambda f, x: x.startswith(f.value),
    D.StringEndsWith: lambda f, x: x.endswith(f.value),
    D.StringContains: lambda f, x: f.value in x,
    D.IsNotNull: lambda f, x: True,
}


class _BinReader(D.DataSourceReader):
    def __init__(self, plan: str):
        self.plan, self.asked = plan, []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        """What is asked of bin alone is settled by leaving bins out; the rest is Spark's."""
        for f in filters:
            if f.attribute == ("bin",) and type(f) in _TESTS:
                self.asked.append(f)
            else:
                yield f

    def partitions(self) -> list[_Ranges]:
        found = json.loads(shared.content(self.plan))
        return packed([tuple(r) for r in found if all(_TESTS[type(f)](f, r[0]) for f in self.asked)]) or [_Ranges([])]

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, bytes]] = []
        size = 0
        for path, begin, end in partition.ranges:
            with shared.opened(path) as file:
                file.seek(begin)
                while file.tell() < end:
                    name = file.read(int.from_bytes(file.read(2), "little")).decode()
                    payload = file.read(int.from_bytes(file.read(4), "little"))
                    held.append((path, name, payload))
                    size += len(payload)
                    if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                        yield _batch(held)
                        held, size = [], 0
        if held:
            yield _batch(held)


def _batch(held: list[tuple[str, str, bytes]]) -> pa.RecordBatch:
    paths, names, payloads = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(paths), pa.array(names), pa.array(payloads, pa.binary())], names=["bin", "filename", "payload"])


# --- writing -----------------------------------------------------------------------------------------------------


class BinFrames(D.DataSource):
    """`binframes`: reads the ranges that the file of option `ranges` lists; writes filename, payload, bin to containers in the folder `path`, which all
    tasks share, under option `key` if it is to be committed once."""

    @classmethod
    def name(cls) -> str:
        return "binframes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> D.DataSourceReader:
        return _BinReader(self.options["ranges"])

    def writer(self, schema, overwrite: bool) -> D.DataSourceWriter:
        return _BinWriter(self.options["path"], self.options.get("key"))

    def streamWriter(self, schema, overwrite: bool) -> D.DataSourceStreamWriter:
        return _BinStreamWriter(self.options["path"], self.options["key"])


class _BinWriter(D.DataSourceWriter):
    """Tasks write to a folder that readers don't look into, which the commit or abort does away with, and what other tries have left with it."""

    def __init__(self, path: str, key: str | None = None):
        self.path, self.key, self.staged = path, key, commits.staging(path)

    def write(self, rows) -> D.WriterCommitMessage:
        """A task that is run again writes files of other names. Rows of a table come sorted by bin; those of a stream come as they arrive, so that a
        bin may be left and taken up in a file more."""
        task, written, name, out = uuid.uuid4().hex, [], None, None
        for row in rows:
            if row["bin"] != name:
                if out:
                    out.close()
                name = row["bin"]
                written.append(f"{name.removesuffix('.bin')}-{task}-{len(written)}.bin")
                out = shared.create(f"{self.staged}/{written[-1]}")
            out.write(framed(row["filename"], bytes(row["payload"])))
        if out:
            out.close()
        return shared.Written(files=written)

    def commit(self, messages, batch: int | None = None) -> None:
        files = [f for message in messages if message for f in message.files]
        commits.commit(self.path, self.staged, files, self.key if batch is None else f"{self.key}-{batch}")

    def abort(self, messages, batch: int | None = None) -> None:
        shared.delete_folder(self.staged)


class _BinStreamWriter(_BinWriter, D.DataSourceStreamWriter):
    """The same for each batch of a stream: a batch that is run again after its commit adds nothing."""

    def __init__(self, path: str, key: str):
        super().__init__(path, key)
        self.staged = commits.staging(path, key)

    def commit(self, messages, batchId: int) -> None:
        super().commit(messages, batchId)
        commits.prune(self.path, self.key, batchId)


def _framed_rows(images: DataFrame, shares: int | None) -> DataFrame:
    rows = images.select("filename", "payload", scalars.bin_name(F.col("arrival")).alias("bin")).filter("filename is not null and payload is not null")
    dealt = rows.hint("rebalance", "bin") if shares is None else rows.repartition("bin", F.pmod(F.xxhash64("filename"), F.lit(shares)))
    return dealt.sortWithinPartitions("bin")


def write(images: DataFrame, path: str, shares: int | None = None, key: str | None = None) -> None:
    """images: filename, payload, arrival. A bin's images come to one task, which writes one container of it, or to several if they are more than Spark's
    advisory size of a partition: so a small bin is one file, however many tasks had some of it. shares: deals each bin to so many tasks, whatever its size.

    key: a name for the job, under which it is committed once: run again it adds nothing. A commit that an earlier job left unfinished is finished."""
    spark = images.sparkSession
    place = shared.qualified(spark, path)
    commits.recover(place)
    spark.dataSource.register(BinFrames)
    writer = _framed_rows(images, shares).write.format("binframes").mode("append")
    (writer.option("key", key) if key else writer).save(place)


def stream(images: DataFrame, path: str, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts writing a stream of images to containers; name tells this stream's batches from others' in the folder. Each image is there once, whatever
    dies: a batch appears with its manifest, and one that is run again is told by it. A micro-batch's images of a bin make one container for each task that
    holds some."""
    spark = images.sparkSession
    place = shared.qualified(spark, path)
    commits.recover(place)
    spark.dataSource.register(BinFrames)
    rows = images.select("filename", "payload", scalars.bin_name(F.col("arrival")).alias("bin")).filter("filename is not null and payload is not null")
    writer = rows.writeStream.format("binframes").option("key", name).option("path", place).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
