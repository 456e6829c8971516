"""Datagrams of the camera: their header, read with Spark expressions.

A UDP socket cannot be read again after a failure, so a collector (see `collector`) lands datagrams as files (columns of
schemas.DATAGRAM) and batch and streaming readers take them from there.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestream import schemas as S

# The header's layout (8-byte file identity), and what a packet's tag says of its body.
LAYOUT = "<IHHQHHHcc"
TAG_NONE, TAG_NAME, TAG_DIRECTORY, TAG_BODY, TAG_IMAGE = range(5)


def _unsigned(data: str, at: int, size: int) -> Column:
    """The little-endian number in `size` bytes at offset `at`."""
    digits = [F.hex(F.substring(data, at + k + 1, 1)) for k in reversed(range(size))]
    return F.conv(F.concat(*digits), 16, 10)


def decoded(datagrams: DataFrame) -> DataFrame:
    """schemas.PACKET of each datagram; those shorter than their header and body are left out (see `malformed`)."""
    ok = datagrams.filter(~is_malformed())
    size = _unsigned("datagram", 18, 2).cast("int")
    return ok.select(
        _unsigned("datagram", 0, 4).cast("long").alias("hash"),
        _unsigned("datagram", 4, 2).cast("int").alias("field"),
        part_of().alias("part"),
        _unsigned("datagram", 8, 8).cast("decimal(20,0)").alias("unique_id"),
        _unsigned("datagram", 16, 2).cast("int").alias("total_parts"),
        size.alias("data_size"),
        _unsigned("datagram", 20, 2).cast("int").alias("tag"),
        F.substring("datagram", F.lit(S.HEADER_BYTES + 1), size).alias("body"),
        "arrival",
    )


def part_of() -> Column:
    """The part index in a datagram's header."""
    return _unsigned("datagram", 6, 2).cast("int")


def is_malformed() -> Column:
    size = F.octet_length("datagram")
    return F.col("datagram").isNull() | (size < S.HEADER_BYTES) | (size < F.lit(S.HEADER_BYTES) + _unsigned("datagram", 18, 2).cast("int"))


def _little_endian(number: Column, size: int) -> Column:
    """The hexadecimal digits of a number's `size` bytes, lowest first."""
    digits = F.lpad(F.hex(number), 2 * size, "0")
    return F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))))


def packed(field: Column, part: Column, unique_id: Column, total_parts: Column, tag: Column, body: Column, hash_: Column | None = None) -> Column:
    """A datagram, as `encoded` makes it, of columns: numbers as longs, the body binary and not null."""
    numbers = ((F.lit(0) if hash_ is None else hash_, 4), (field, 2), (part, 2), (unique_id, 8), (total_parts, 2), (F.octet_length(body), 2), (tag, 2), (F.lit(0), 2))
    return F.unhex(F.concat(*(_little_endian(n.cast("long"), size) for n, size in numbers), F.hex(body)))


#: Why a datagram is turned away.
MISSING, SHORT, TORN, OUT_OF_RANGE = "missing", "shorter than a header", "shorter than its body", "part out of range"


def judged(datagrams: DataFrame) -> DataFrame:
    """datagrams with `reason` for which each is turned away, null for those that are taken: one pass tells both, so that accepted and rejected
    ones add up to what came (see quarantine.parted)."""
    size = F.octet_length("datagram")
    reason = (
        F.when(F.col("datagram").isNull(), MISSING)
        .when(size < S.HEADER_BYTES, SHORT)
        .when(is_malformed(), TORN)
        .when(part_of() >= S.MOST_PARTS, OUT_OF_RANGE)
    )
    return datagrams.withColumn("reason", reason)


def malformed(datagrams: DataFrame) -> DataFrame:
    """Datagrams that end within their header or before the body that it announces."""
    return datagrams.filter(is_malformed())


def encoded(field: int, part: int, unique_id: int, total_parts: int, tag: int, body: bytes, hash_: int = 0) -> bytes:
    """One datagram."""
    return struct.pack(LAYOUT, hash_, field, part, unique_id, total_parts, len(body), tag, b"\0", b"\0") + body


def landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.DATAGRAM).parquet(path)


def landed_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """The rate limit takes the place of a bounded queue: a slow query falls behind and drops nothing."""
    return spark.readStream.schema(S.DATAGRAM).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def whole_images(spark: SparkSession, path: str) -> DataFrame:
    """Datagrams that each are one whole image, as files of a folder."""
    return spark.read.format("binaryFile").load(path).select(F.col("content").alias("payload"), F.col("modificationTime").alias("arrival"))
