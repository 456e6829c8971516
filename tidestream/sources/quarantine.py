"""Rows that are turned away, kept with the reason instead of being lost: packets, control texts, tables of measurements.

Each source judges its rows in one pass, which adds `reason` (null: taken). `parted` counts both kinds under an observation as it writes
them to one table by kind, so that what was accepted and what was rejected always add up to what came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidestream import schemas as S
from tidestream.functions import scalars
from tidestream.sources import files

#: Why a control text, a line of it, or a row of measurements is turned away.
LINES, WIDTH, NUMBERS = "not as many lines as windows", "not two values", "not whole numbers"
UNREADABLE, NO_NAME, NO_POINTS = "not of the columns", "no name", "points do not parse"


def judged_controls(controls: DataFrame, text: str = "text", exact: int | None = files.CONTROL_ROWS) -> DataFrame:
    """Each line of each control text, blank ones aside, with n (from 1; null for a text turned away as a whole), line, hits, misses, reason.

    A text without another number of lines than exact, null among them, is one row: a row of it can't tell which window it speaks of. Of a text that
    has them, each line is judged by itself."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), lambda x: F.trim(x) != "")
    rows = controls.withColumn("__lines", lines)
    whole = F.lit(True) if exact is None else F.size("__lines") == exact
    others = [c for c in controls.columns if c != text]
    both = F.when(whole, F.transform("__lines", lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))).otherwise(F.array(F.struct(F.lit(None).cast("int").alias("n"), F.col(text).alias("line"))))
    rows = rows.select(*others, F.inline(both))
    values = F.split("line", ",")
    number = lambda k: F.when(F.col("n").isNotNull() & (F.size(values) == 2), F.trim(F.get(values, k)).try_cast("bigint"))
    rows = rows.withColumns({"hits": number(0), "misses": number(1)})
    reason = F.when(F.col("n").isNull(), LINES).when(F.size(values) != 2, WIDTH).when(F.col("hits").isNull() | F.col("misses").isNull(), NUMBERS)
    return rows.withColumn("reason", reason)


def judged_measures(spark, path: str) -> DataFrame:
    """Rows of headerless tables of measurements with `line` (null if the row could be read) and reason. A row that measured nothing has no points and is
    taken; one whose points are there and don't parse is not."""
    schema = T.StructType([*T.StructType.fromDDL(S.MEASURES_CSV).fields, T.StructField("line", T.StringType())])
    rows = spark.read.schema(schema).option("header", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "line").csv(path)
    points = F.coalesce(scalars.parse_points(F.col("max_points")), F.from_json("max_points", "array<array<int>>"))
    points = F.when((F.size(points) == 2) & F.forall(points, lambda p: F.forall(p, lambda x: x.isNotNull())), points)
    reason = F.when(F.col("line").isNotNull(), UNREADABLE).when(F.col("filename").isNull(), NO_NAME).when(F.col("max_points").isNotNull() & points.isNull(), NO_POINTS)
    return rows.withColumns({"reason": reason, "points": points}).drop("max_points").withColumnRenamed("points", "max_points")


def counted(rows: DataFrame, observation: Observation | str) -> DataFrame:
    """rows (judged), observed: how many came, were accepted, and were rejected."""
    came, taken = F.count(F.lit(1)), F.count(F.when(F.col("reason").isNull(), 1))
    return rows.observe(observation, came.alias("came"), taken.alias("accepted"), (came - taken).alias("rejected"))


def parted(rows: DataFrame, path: str, mode: str = "append") -> dict[str, int]:
    """Writes rows (judged) to one table by kind, path/rejected=false and path/rejected=true, in one pass; its counts."""
    observation = Observation()
    counted(rows, observation).withColumn("rejected", F.col("reason").isNotNull()).write.mode(mode).partitionBy("rejected").parquet(path)
    return observation.get


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter("reason is null").drop("reason")


def reasons(rows: DataFrame) -> DataFrame:
    """reason, n: how many rows were turned away for each."""
    return rows.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
