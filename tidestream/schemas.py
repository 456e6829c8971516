"""Row types of the engine's data: packets, control rows, measurements, window records."""

from __future__ import annotations

from pyspark.sql import types as T

#: Length of a packet's header; most bytes of its body; parts of a file from this index on are rejected.
HEADER_BYTES, BODY_BYTES, MOST_PARTS = 24, 8192, 1024

DATAGRAM = T.StructType([T.StructField("datagram", T.BinaryType()), T.StructField("arrival", T.TimestampType())])

PACKET = T.StructType(
    [
        T.StructField("hash", T.LongType()),
        T.StructField("field", T.IntegerType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("unique_id", T.DecimalType(20, 0)),
        T.StructField("total_parts", T.IntegerType()),
        T.StructField("data_size", T.IntegerType()),
        T.StructField("tag", T.IntegerType()),
        T.StructField("body", T.BinaryType()),
        T.StructField("arrival", T.TimestampType()),
    ]
)

IMAGE = T.StructType([T.StructField("filename", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("arrival", T.TimestampType())])

POINTS = T.ArrayType(T.ArrayType(T.IntegerType()))

#: esd_1 and threshold_area are of the opened shape ("standard"), esd_2 and threshold_area_otsu of the thresholded one.
#: Areas are in pixels, diameters in micrometres, the length in pixels.
MEASURES = T.StructType(
    [
        T.StructField("esd_1", T.DoubleType()),
        T.StructField("esd_2", T.DoubleType()),
        T.StructField("threshold_area", T.DoubleType()),
        T.StructField("threshold_area_otsu", T.DoubleType()),
        T.StructField("object_length", T.DoubleType()),
        T.StructField("max_points", POINTS),
    ]
)

POSITION = T.StructType([T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()), T.StructField("image_datetime", T.StringType()), T.StructField("gps_ok", T.BooleanType())])

EXIF = T.StructType([T.StructField("width", T.LongType()), T.StructField("length", T.LongType()), T.StructField("datetime", T.StringType())])

PREDICTION = T.StructType([T.StructField("label", T.StringType()), T.StructField("scores", T.ArrayType(T.FloatType()))])

#: A headerless table of measurements: the name, then MEASURES with the points as text.
MEASURES_CSV = "filename string, esd_1 double, esd_2 double, threshold_area double, threshold_area_otsu double, object_length double, max_points string"
