"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Targets: sources in code point order (null last) weigh WEIGHTS, repeating, and share SHARE of all words; no target exceeds
MOST times its source, and the excess is shared again by weight until none does. Each source's documents stand in an order
drawn from a hash of doc_id; the mix takes words from its start, a second time through if need be, up to the target (the
last document taken may be cut). A source's demand runs over training time as the integral of its weight schedule
1 + tilt * (2t - 1), which grows, stays or falls by TILTS; inverting it at a document's cumulative words gives its
training position, and documents are range-sorted by position.

Cumulative words are hierarchical: sums of hash buckets within a source, then rows within a bucket, so no source, however
hot, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidestream.llm import common as C

WEIGHTS, TILTS = (3, 1, 2), (0.5, 0.0, -0.5)
#: Words of the mix as a share of all words, and how often a source's words may be taken at most.
SHARE, MOST = 1.5, 2
#: Leading hexadecimal digits of the hash that make a bucket of a source: 4096 buckets.
DIGITS = 3


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.size(C.word_array(F.coalesce(text, F.lit("")))).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """sources (key, source, source_size), one row each, with target, weight and tilt: one row per source meets in a window, no documents."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(WEIGHTS)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (turn + 1).cast("int"))
    rows = sources.select("key", "source", "source_size", pick(WEIGHTS).cast("long").alias("weight"), pick(TILTS).alias("tilt"))
    cap = F.col("source_size") * MOST
    everything = Window.partitionBy()
    line = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    left = (F.lit(SHARE) * total - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.select("*", cap.alias("cap"), left.alias("level"), (cap / F.col("weight")).alias("full_at"))
    level = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "level"))).over(everything)["level"]  # that of the first source it doesn't fill
    return rows.select("key", "source_size", "tilt", F.least(F.col("weight") * level, F.col("cap").cast("double")).alias("target"))


def position(share: Column, tilt: Column) -> Column:
    """The time t in [0, 1] at which (1 - tilt) t + tilt t^2 reaches share."""
    b = F.lit(1.0) - tilt
    root = (F.sqrt(b * b + F.lit(4.0) * tilt * share) - b) / (F.lit(2.0) * tilt)
    return F.when(tilt == 0, share).otherwise(root)


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_position, second_position (null if not taken), in order of position.

    Null or blank text: size 0, nothing taken. Null source: a source of its own, last. Equal doc_ids are rows of their own,
    in order of size. Other columns are not looked at."""
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    rank = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = C.checkpointed(docs.select("doc_id", "source", key.alias("key"), rank.alias("rank"), n_words(F.col("text")).alias("size")).withColumn("bucket", F.substring("rank", 1, DIGITS)))
    sums = C.checkpointed(rows.groupBy("key", "bucket").agg(F.sum("size").alias("bucket_size"), F.any_value("source").alias("source")))
    sources = sums.groupBy("key").agg(F.any_value("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("key", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("start"))
    starts = starts.join(targets(sources), "key")
    inside = Window.partitionBy("key", "bucket").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.drop("source").join(starts, ["key", "bucket"]).withColumn("from", F.col("start") + F.sum("size").over(inside) - F.col("size"))
    goal = F.floor(F.col("target")).cast("long")
    take = lambda done: F.greatest(F.lit(0), F.least(F.col("size"), goal - done))
    both = both.withColumns({"once": take(F.col("from")), "again": take(F.col("from") + F.col("source_size"))})
    at = lambda n, done: F.when(F.col(n) > 0, position((done + F.col(n) / 2) / F.col("target"), F.col("tilt")))
    out = both.select(
        *("doc_id", "size", "source_size", "target"),
        (F.col("once") + F.col("again")).alias("taken"),
        at("once", F.col("from")).alias("first_position"),
        at("again", F.col("from") + F.col("source_size")).alias("second_position"),
    )
    return C.checkpointed(out).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")
