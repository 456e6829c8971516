"""Folders of images, tables of results, control files; and the sinks that write them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidestream import schemas as S
from tidestream.functions import scalars
from tidestream.sources import commits, shared

#: Rows of a control file that count: one per window that may still be corrected.
CONTROL_ROWS = 10


# --- sources ---------------------------------------------------------------------------------------------------


def _binary(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return files.select(scalars.basename(F.col("path")).alias("filename"), F.col("content").alias("payload"), F.col("modificationTime").alias("arrival"), "path")


def images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """filename, payload, arrival, path of the image files of a folder (or of one file). Files of one name are told
    apart by their path."""
    return _binary(spark, path, recursive).filter(scalars.has_image_suffix(F.col("filename")))


def is_tiff_name(name: Column) -> Column:
    return F.instr(name, "tif") > 0


def tiffs(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """The same of those with `tif` anywhere in their name."""
    return _binary(spark, path, recursive).filter(is_tiff_name(F.col("filename")))


def measures(spark: SparkSession, path: str) -> DataFrame:
    """A headerless table of measurements, its points parsed, be they JSON (as `write_table` writes them) or printed arrays; rows whose
    points don't parse have none."""
    rows = spark.read.schema(S.MEASURES_CSV).option("header", False).csv(path)
    points = F.coalesce(scalars.parse_points(F.col("max_points")), F.from_json("max_points", "array<array<int>>"))
    return rows.withColumn("max_points", F.when(F.size(points) == 2, points))


def control_rows(controls: DataFrame, text: str = "text", exact: int | None = CONTROL_ROWS) -> DataFrame:
    """Each row of each control text (lines `hits,misses`; blank ones don't count) as n (from 1), hits, misses.

    exact: texts with another number of rows are left out. A value that isn't a whole number is null."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    rows = controls.withColumn("__lines", lines)
    if exact is not None:
        rows = rows.filter(F.size("__lines") == exact)
    number = lambda k: F.trim(F.get(F.split("__line", ","), k)).try_cast("bigint")
    out = rows.select(*[c for c in controls.columns if c != text], F.posexplode("__lines").alias("__n", "__line"))
    return out.withColumns({"n": F.col("__n") + 1, "hits": number(0), "misses": number(1)}).drop("__n", "__line")


# --- sinks -----------------------------------------------------------------------------------------------------


def write_table(rows: DataFrame, path: str, header: bool = True) -> None:
    """Appends to a folder of CSV files; lists are written as JSON text."""
    plain = rows.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in rows.dtypes])
    plain.write.mode("append").option("header", header).csv(path)


class ImageFiles(D.DataSource):
    """`imagefiles`: writes each row's payload to a file of its own, called filename, in the folder `path`, under option `key` if it is to be committed
    once."""

    @classmethod
    def name(cls) -> str:
        return "imagefiles"

    def writer(self, schema, overwrite: bool) -> D.DataSourceWriter:
        return _ImageWriter(self.options["path"], self.options.get("key"))

    def streamWriter(self, schema, overwrite: bool) -> D.DataSourceStreamWriter:
        return _ImageStreamWriter(self.options["path"], self.options["key"])


class _ImageWriter(D.DataSourceWriter):
    """Each task writes into a folder of its own within the job's, which readers skip; the commit makes the files of the tasks that were taken appear."""

    def __init__(self, path: str, key: str | None = None):
        self.path, self.key, self.staged = path, key, commits.staging(path)

    def write(self, rows) -> D.WriterCommitMessage:
        out, task = shared.Written(), uuid.uuid4().hex
        for row in rows:
            name = row["filename"].replace("\\", "/").rpartition("/")[2]  # never out of the folder
            if name in ("", ".", ".."):
                continue
            with shared.create(f"{self.staged}/{task}/{name}") as f:
                f.write(bytes(row["payload"]))
            out.files.append(f"{task}/{name}")
        out.files = list(dict.fromkeys(out.files))
        return out

    def commit(self, messages, batch: int | None = None) -> None:
        files = [f for message in messages if message for f in message.files]
        commits.commit(self.path, self.staged, files, self.key if batch is None else f"{self.key}-{batch}")

    def abort(self, messages, batch: int | None = None) -> None:
        shared.delete_folder(self.staged)


class _ImageStreamWriter(_ImageWriter, D.DataSourceStreamWriter):
    def __init__(self, path: str, key: str):
        super().__init__(path, key)
        self.staged = commits.staging(path, key)

    def commit(self, messages, batchId: int) -> None:
        super().commit(messages, batchId)
        commits.prune(self.path, self.key, batchId)


def _named(images: DataFrame, prefix: Column | None) -> DataFrame:
    name = F.col("filename") if prefix is None else F.concat(F.coalesce(F.concat(prefix, F.lit("-")), F.lit("")), F.col("filename"))
    return images.select(name.alias("filename"), "payload").filter("filename is not null and payload is not null")


def write_images(images: DataFrame, path: str, prefix: Column | None = None, clash: str = "error", key: str | None = None) -> None:
    """One file per image; prefix (a label) goes before its name with a dash. clash: whether images of one name are an error, found before
    anything is written, or overwrite each other.

    All files appear at the commit, or none. key: a name for the job, under which it is committed once. A commit that an earlier job left unfinished is
    finished first."""
    spark = images.sparkSession
    spark.dataSource.register(ImageFiles)
    rows = _named(images, prefix)
    if clash == "error":
        again = rows.select(scalars.basename(F.col("filename")).alias("name")).groupBy("name").count().filter("count > 1").first()
        if again:
            raise ValueError(f"{again['count']} images are called {again['name']}")
    place = shared.qualified(spark, path)
    commits.recover(place)
    writer = rows.write.format("imagefiles").mode("append")
    (writer.option("key", key) if key else writer).save(place)


def stream_images(images: DataFrame, path: str, name: str, checkpoint: str, prefix: Column | None = None, **trigger) -> StreamingQuery:
    """Starts writing a stream of images to files; name tells this stream's batches from others' in the folder. The files of a batch appear with its
    manifest, and a batch that is run again adds nothing; of images of one name the last batch's stays."""
    spark = images.sparkSession
    place = shared.qualified(spark, path)
    commits.recover(place)
    spark.dataSource.register(ImageFiles)
    writer = _named(images, prefix).writeStream.format("imagefiles").option("key", name).option("path", place).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
