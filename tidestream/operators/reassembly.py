"""Files put together from their packets, and sampling of what arrives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidestream import schemas as S
from tidestream.functions import scalars
from tidestream.sources import packets as P


def rejected(packets: DataFrame) -> DataFrame:
    """Packets whose part is out of range."""
    return packets.filter(F.col("part") >= S.MOST_PARTS)


def _joined(parts: Column) -> Column:
    """The bodies of parts, an array of structs, one after the other."""
    return F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["body"])), ""))


def reassembled(packets: DataFrame) -> DataFrame:
    """filename, payload, arrival (of the last packet) of each complete file, once.

    A file is complete when it has all parts below total_parts, which is one at least; others don't count. Of packets of one part the last to arrive counts. Part
    tagged as a name gives the name, parts from 1 on the payload, in order. At most MOST_PARTS parts of BODY_BYTES meet in one row."""
    part = F.struct("arrival", "body", "tag")
    latest = packets.filter(F.col("part") < S.MOST_PARTS).groupBy("field", "unique_id", "part").agg(F.max(part).alias("p"), F.max("total_parts").alias("total"))
    rows = latest.select("field", "unique_id", "total", F.struct("part", F.col("p.body").alias("body"), F.col("p.tag").alias("tag"), F.col("p.arrival").alias("arrival")).alias("part"))
    files = rows.groupBy("field", "unique_id").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.max("total").alias("total"), F.max("part.arrival").alias("arrival"))
    files = files.filter("total > 0").withColumn("parts", F.filter("parts", lambda p: p["part"] < F.col("total")))
    whole = files.filter(F.size("parts") >= F.col("total"))
    name = F.get(F.filter("parts", lambda p: p["tag"] == P.TAG_NAME), 0)["body"]
    body = F.filter("parts", lambda p: p["part"] >= 1)
    return whole.select(scalars.basename(name.cast("string")).alias("filename"), _joined(body).alias("payload"), "arrival")


def routed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Particle images, and control texts (text, arrival)."""
    marked = files.withColumn("__route", scalars.route(F.col("filename")))
    control = marked.filter("__route = 'control'").select(F.col("payload").cast("string").alias("text"), "arrival")
    return marked.filter("__route = 'image'").drop("__route"), control


def numbered(rows: DataFrame, order: list[str], bucket: Column, name: str = "rn") -> DataFrame:
    """rows with their place (from 1) in the order of `order`, of which bucket is a non-decreasing function.

    Places are counted within buckets and buckets added up, so no task orders all rows."""
    rows = rows.withColumn("__bucket", bucket)
    counts = rows.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy(F.col("__bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    starts = counts.select(F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    both = rows.withColumn("__inside", inside).join(starts, F.col("__bucket").eqNullSafe(F.col("__b")))
    return both.withColumn(name, F.col("__start") + F.col("__inside")).drop("__bucket", "__b", "__start", "__inside")


def every_nth(rows: DataFrame, n: int, order: list[str], bucket: Column) -> DataFrame:
    """Every n-th row in order; `rn` is its place."""
    return numbered(rows, order, bucket).filter(F.col("rn") % n == 0)


def micro_batches(rows: DataFrame, size: int, group: list[str], order: list[str]) -> DataFrame:
    """rows with `batch`: within each group, each `size` rows in order are one."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("batch", F.floor((place - 1) / size))
