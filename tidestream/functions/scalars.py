"""Scalar functions as Spark expressions; nothing here runs Python on the executors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Litres a minute that pass the camera; micrometres along a pixel.
FLOW, PIXEL = 34, 10
# Weights of red, green and blue in a gray value.
GRAY = (0.2125, 0.7154, 0.0721)


# --- names ---------------------------------------------------------------------------------------------------


def basename(path: Column) -> Column:
    """What follows the last slash of either kind."""
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def extension(name: Column) -> Column:
    """From the last dot on, dot included; empty without one."""
    return F.regexp_extract(name, r"(\.[^.]*)$", 1)


def has_image_suffix(name: Column) -> Column:
    return name.rlike(r"\.(jpg|jpeg|tif|tiff|png)$")


def is_particle_image(name: Column) -> Column:
    """A .tif (lower case) that isn't the background image."""
    return name.endswith(".tif") & (F.lower(name) != "background.tif")


def is_control(name: Column) -> Column:
    return name == "HitsMisses.txt"


def route(name: Column) -> Column:
    """image, control or other, by the name of a file."""
    return F.when(is_particle_image(name), "image").when(is_control(name), "control").otherwise("other")


# --- time ----------------------------------------------------------------------------------------------------


def bin_name(at: Column) -> Column:
    """The name of the ten-minute container that an arrival belongs to."""
    return F.concat(F.lit("pi-"), F.date_format(at, "yyyy-MM-dd-HH-"), F.floor(F.minute(at) / 10).cast("string"), F.lit("0.bin"))


def next_boundary(at: Column) -> Column:
    """The end of the minute that an instant is in."""
    return F.date_trunc("minute", at) + F.expr("INTERVAL 1 MINUTE")


def iso_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def rate(count: Column, first: Column, last: Column) -> Column:
    """Things a second between two instants; null if they are one."""
    return F.try_divide(count.cast("double"), (F.unix_micros(last) - F.unix_micros(first)) / 1e6)


# --- measurements --------------------------------------------------------------------------------------------


def dms_to_degrees(degrees: Column, minutes: Column, seconds: Column, reference: Column) -> Column:
    """Decimal degrees; south and west are negative."""
    size = degrees.cast("double") + minutes.cast("double") / 60 + seconds.cast("double") / 3600
    return F.when(reference.isin("S", "W"), -size).otherwise(size)


def equivalent_diameter(area: Column) -> Column:
    """Micrometres across the disc whose area is that many pixels."""
    return 2 * F.sqrt(area.cast("double") * (PIXEL * PIXEL) / F.pi())


def concentration(hits: Column, misses: Column, every: Column, count: Column) -> Column:
    """Particles a litre: the count raised by the share of missed images and by the sampling, over the flow."""
    return F.round((hits + misses) / hits * every * count / FLOW, 3)


def extent(a: Column, b: Column) -> Column:
    """The lesser and the greater of two estimates."""
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def midpoint(points: Column) -> Column:
    """The integer point halfway between two points [x, y]."""
    return F.transform(F.get(points, 0), lambda x, i: ((x + F.get(F.get(points, 1), i)) / 2).cast("int"))


def parse_points(printed: Column) -> Column:
    """Two points from the text of a pair of printed integer arrays; null if it isn't one."""
    arrays = F.regexp_extract_all(printed, F.lit(r"\[\[([-0-9, ]+)\]\]"), F.lit(1))
    points = F.transform(arrays, lambda a: F.transform(F.split(a, r",\s*"), lambda x: x.try_cast("int")))
    return F.when(F.size(points) == 2, points)


# --- class scores and pixels -----------------------------------------------------------------------------------


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: inside a lambda Spark would work out an outer expression again for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def softmax(outputs: Column) -> Column:
    powers = _bound(F.array_max(outputs).cast("double"), lambda most: F.transform(outputs, lambda x: F.exp(x.cast("double") - most)))
    shares = lambda p: _bound(F.aggregate(p, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(p, lambda x: x / total))
    return _bound(powers, shares)


def argmax(values: Column) -> Column:
    """Place of the first greatest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def predicted(values: Column, labels: Sequence[str]) -> Column:
    return F.get(F.array(*map(F.lit, labels)), argmax(values))


def gray(pixel: Column) -> Column:
    """Of an array of red, green and blue."""
    return sum((F.get(pixel, k).cast("double") * w for k, w in enumerate(GRAY)), F.lit(0.0))


def less_background(pixels: Column, background: Column) -> Column:
    """Each value of 0..255 less what its background lacks to white, not below black."""
    return F.zip_with(pixels, background, lambda p, b: F.greatest(F.lit(0.0), F.least(F.lit(255.0), p - (F.lit(255.0) - b))))
