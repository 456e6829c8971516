"""Whole jobs: from packets to corrected window records, of what has landed or as it lands, and the folder jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidestream import schemas as S
from tidestream.functions import images as I
from tidestream.functions import scalars
from tidestream.functions.labels import LABEL_KEYS
from tidestream.operators import joins, reassembly, windows
from tidestream.sources import checkpoints, files, packets
from tidestream.streaming import publish, sampling
from tidestream.streaming import reassembly as stream_files
from tidestream.streaming import windows as stream_windows


@dataclass(frozen=True)
class Settings:
    """What a run does. every: one in so many images is looked at; batch: images classified at a time."""

    survey: str = ""
    version: str = ""
    system_serial_no: str = ""
    every: int = 1
    batch: int = 255
    gray: bool = False
    correct_background: bool = True
    classify: bool = True
    measure: bool = True
    locate: bool = True
    labels: tuple[str, ...] = field(default=LABEL_KEYS)
    scorer: Callable = I.stand_in_scorer


#: Means of a record, by the measurement they are of.
MEANS = {"esd_1": "equispherdiameter_standard", "esd_2": "equispherdiameter_otsu", "threshold_area": "thresholdArea_standard", "threshold_area_otsu": "thresholdArea_otsu", "object_length": "objectlength"}


def sampled(images: DataFrame, every: int) -> DataFrame:
    """One image in `every`, by order of arrival."""
    if every == 1:
        return images
    return reassembly.every_nth(images, every, ["arrival", "filename"], windows.minute()).drop("rn")


def enriched(images: DataFrame, settings: Settings) -> DataFrame:
    """filename, arrival and, as settings ask, position (of the image as it came), label with scores, measures (of the corrected image).

    Each image is decoded once, in one pass of one function."""
    s = settings
    seen = I.viewer(s.scorer, s.labels, s.gray, s.batch, s.correct_background, s.classify, s.measure, s.locate)
    rows = images.select("filename", "arrival", seen("payload").alias("seen"))
    parts = {"position": (s.locate, S.POSITION), "prediction": (s.classify, S.PREDICTION), "measures": (s.measure, S.MEASURES)}
    return rows.select("filename", "arrival", *(F.struct(*(F.col(f"seen.{f}") for f in kind.names)).alias(name) for name, (asked, kind) in parts.items() if asked))


def window_records(rows: DataFrame, controls: DataFrame, settings: Settings) -> DataFrame:
    """One record per corrected window, delayed; rows: enriched, controls: text, arrival."""
    null = lambda kind: F.lit(None).cast(kind)
    value: dict[str, Column] = {m: F.col(f"measures.{m}") if settings.measure else null("double") for m in MEANS}
    place = {c: F.col(f"position.{c}") if settings.locate else null("double") for c in ("latitude", "longitude")}
    label = F.col("prediction.label") if settings.classify else null("string")
    flat = rows.select("arrival", label.alias("label"), *(c.alias(n) for n, c in (value | place).items()))
    # all of a window in one aggregation, kept in a checkpoint, so images are decoded once
    counts = [F.count(F.when(F.col("label") == x, 1)).alias(x) for x in settings.labels]
    means = [F.round(F.avg(c), 3).alias(n) for c, n in MEANS.items()]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("arrival"))).alias(c) for c in place]
    closed = flat.groupBy(windows.minute().alias("minute")).agg(*counts, *means, *last, F.max("arrival").alias("time_end"))
    closed = windows.sequenced(checkpoints.checkpointed(closed))
    over = windows.Window.orderBy("minute").rowsBetween(windows.Window.unboundedPreceding, windows.Window.currentRow)
    closed = closed.withColumns({c: F.last(c, ignorenulls=True).over(over) for c in place})
    control = files.control_rows(windows.control_sequence(controls, closed))
    out = windows.corrected(closed, windows.corrections(control), settings.labels, settings.every)
    fixed = {"survey": settings.survey, "version": settings.version, "system_serial_no": settings.system_serial_no}
    out = out.select(*(F.lit(v).alias(k) for k, v in fixed.items()), F.lit(settings.every).alias("edgeSubRate"), F.col("minute").alias("time_start"), *[c for c in out.columns if c not in ("minute", "win_seq")])
    return out.withColumn("timestamp", scalars.iso_stamp(F.current_timestamp()))


def from_packets(spark: SparkSession, path: str, settings: Settings) -> DataFrame:
    """Records of the datagrams that have landed at path."""
    particles, controls = reassembly.routed(reassembly.reassembled(packets.decoded(packets.landed(spark, path))))
    return window_records(enriched(sampled(particles, settings.every), settings), controls, settings)


# --- the live stream -----------------------------------------------------------------------------------------------

#: What the live form keeps of an image.
LOOKED_AT = T.StructType([T.StructField("filename", T.StringType()), T.StructField("arrival", T.TimestampType()), *(f for f in I.SEEN if not isinstance(f.dataType, T.ArrayType))])


def _looker(settings: Settings) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What is seen of a batch of images, which the model takes at once."""
    s = settings
    seen = I.viewer(s.scorer, s.labels, s.gray, s.batch, s.correct_background, s.classify, s.measure, s.locate).func

    def look(rows: pd.DataFrame) -> pd.DataFrame:
        (found,) = seen(iter([rows["payload"]]))
        return pd.concat([rows[["filename", "arrival"]].reset_index(drop=True), found[LOOKED_AT.names[2:]]], axis=1)

    return look


def live(spark: SparkSession, landed: str, folder: str, settings: Settings, transport: publish.Transport, lateness: str = "1 minute") -> list[tuple[str, Callable[..., StreamingQuery]]]:
    """The queries of a running instrument, in the order in which they feed each other by tables in folder, each by name with what starts it (given
    a trigger): files put together from the datagrams at landed; every n-th image; images looked at in batches that are released when full or when their
    minute closes; closed minutes; control texts; corrected records, sent through an outbox. Each goes on from its own checkpoint, so a restart of any loses
    nothing and does nothing twice."""
    tables = {
        "files": S.IMAGE,
        "sampled": T.StructType([*S.IMAGE.fields, T.StructField("rn", T.LongType())]),
        "seen": T.StructType([T.StructField("minute", T.TimestampType()), T.StructField("batch", T.LongType()), *LOOKED_AT.fields]),
        "closed": T.StructType([T.StructField("minute", T.TimestampType()), *(T.StructField(x, T.LongType()) for x in settings.labels), *(T.StructField(m, T.DoubleType()) for m in MEANS.values())]),
        "controls": T.StructType([T.StructField("arrival", T.TimestampType()), T.StructField("rows", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "hits", "misses")])))]),
    }

    def read(name: str) -> DataFrame:
        return spark.readStream.schema(tables[name]).parquet(f"{folder}/{name}")

    def controls() -> DataFrame:
        texts = reassembly.routed(read("files"))[1]
        lines = F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != "")
        number = lambda line, k: F.trim(F.get(F.split(line, ","), k)).try_cast("bigint")
        rows = F.transform(lines, lambda x, i: F.struct((i + 1).cast("long").alias("n"), number(x, 0).alias("hits"), number(x, 1).alias("misses")))
        return texts.select("arrival", rows.alias("rows"))

    made = {
        "files": lambda: stream_files.reassembled(packets.decoded(packets.landed_stream(spark, landed)), lateness=lateness),
        "sampled": lambda: sampling.every_nth(reassembly.routed(read("files"))[0], settings.every),
        "seen": lambda: sampling.batched(read("sampled").drop("rn"), settings.batch, lateness, function=_looker(settings), schema=LOOKED_AT),
        "closed": lambda: stream_windows.closed_windows(read("seen"), settings.labels, MEANS if settings.measure else None, lateness),
        "controls": controls,
    }

    def start(name: str) -> Callable[..., StreamingQuery]:
        def begin(**trigger) -> StreamingQuery:
            spark.createDataFrame([], tables[name]).write.mode("ignore").parquet(f"{folder}/{name}")  # there for whoever reads it
            writer = made[name]().writeStream.queryName(f"live-{name}").format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/_checkpoints/{name}")
            return (writer.trigger(**trigger) if trigger else writer).start()

        return begin

    def send(**trigger) -> StreamingQuery:
        records = stream_windows.emitted(read("closed"), read("controls"), settings.labels, settings.every)
        return publish.published(records.select("minute", F.col("record").alias("payload")), "minute", f"{folder}/outbox", transport, f"{folder}/_checkpoints/records", **trigger)

    return [*((name, start(name)) for name in made), ("records", send)]


# --- folder jobs -------------------------------------------------------------------------------------------------


def classify_folder(spark: SparkSession, path: str, out: str, recursive: bool = False, settings: Settings = Settings()) -> None:
    """filename, label, score for each class, of the TIFF files of a folder."""
    found = files.tiffs(spark, path, recursive).select("filename", I.classifier(settings.scorer, settings.labels, settings.gray, settings.batch)("payload").alias("p"))
    files.write_table(found.select("filename", F.col("p.label").alias("label"), F.col("p.scores").alias("scores")), out)


def measure_folder(spark: SparkSession, path: str, out: str) -> None:
    found = files.images(spark, path).select("filename", I.measured("payload").alias("m"))
    files.write_table(found.select("filename", "m.*"), out, header=False)


def locate_folder(spark: SparkSession, path: str, out: str) -> None:
    found = files.images(spark, path).select("filename", I.positioned("payload").alias("p"))
    files.write_table(found.select("filename", "p.latitude", "p.longitude", "p.image_datetime"), out)


def correct_folder(spark: SparkSession, path: str, out: str) -> None:
    files.write_images(files.tiffs(spark, path).select("filename", I.background_corrected("payload").alias("payload")), out)


def draw_folder(spark: SparkSession, table: str, path: str, out: str) -> None:
    """Draws what a table of measurements (as measure_folder writes it) says of a folder's images."""
    found = joins.with_images(files.measures(spark, table), files.images(spark, path))
    radius = lambda c: F.col(c) / (2 * scalars.PIXEL)
    files.write_images(found.select("filename", I.drawn("payload", radius("esd_1"), radius("esd_2"), "max_points").alias("payload")), out)
