"""Lookups by pattern, results joined with their images, and the widest pair of points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidestream.functions import shapes

#: Groups into which the partial hulls of a group of points are merged first.
SHARES = 64
#: Patterns up to which they are broadcast.
BROADCAST_PATTERNS = 10_000


def label_groups(rows: DataFrame, label: str, patterns: DataFrame, default: str = "Other") -> DataFrame:
    """rows with `label_group`: of the first pattern (by rank) that the label equals or, where the pattern ends in `*`,
    begins with.

    patterns: rank, pattern, label_group. Distinct labels are matched, each by equality with its own prefixes, so there
    is no theta join; then labels are joined back."""
    stars = F.col("pattern").endswith("*")
    known = patterns.select("rank", "label_group", F.when(stars, F.expr("left(pattern, length(pattern) - 1)")).otherwise(F.col("pattern")).alias("__stem"), stars.alias("__open"))
    few = patterns.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS
    labels = rows.select(F.col(label).alias("__label")).filter("__label is not null").distinct()
    prefixes = labels.select("__label", F.explode(F.sequence(F.lit(0), F.length("__label"))).alias("__n"))
    prefixes = prefixes.select("__label", F.left("__label", F.col("__n")).alias("__stem"), (F.col("__n") == F.length("__label")).alias("__whole"))
    hits = prefixes.join(F.broadcast(known) if few else known, "__stem").filter("__open or __whole")
    best = hits.groupBy("__label").agg(F.min_by("label_group", "rank").alias("label_group"))
    out = rows.join(best, rows[label] == best["__label"], "left").drop("__label")
    return out.withColumn("label_group", F.coalesce("label_group", F.lit(default)))


def next_at(rows: DataFrame, at: str, marks: DataFrame, mark: str, unit: str = "hour") -> DataFrame:
    """rows with the columns of the first of marks whose time is not before theirs; null where none follows, or where they have no time. marks have
    distinct times; columns of one name are those of rows.

    Both are laid in one line in time, cut in pieces of a unit. Within a piece each row takes what follows; what nothing follows there takes the
    first mark of a later piece, and of that there is one row a piece. So no task orders all rows, and nothing is compared in pairs."""
    new = [c for c in marks.columns if c not in rows.columns]
    values = F.struct(*(F.col(c) for c in new))
    line = marks.filter(F.col(mark).isNotNull()).select(F.col(mark).alias("__at"), F.lit(1).alias("__kind"), values.alias("__next"), F.lit(None).cast(rows.schema).alias("__row"))
    line = line.unionByName(rows.select(F.col(at).alias("__at"), F.lit(0).alias("__kind"), F.struct(*rows.columns).alias("__row")), allowMissingColumns=True)
    line = line.withColumn("__piece", F.date_trunc(unit, "__at"))
    ahead = Window.partitionBy("__piece").orderBy("__at", "__kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    inside = line.withColumn("__next", F.first("__next", ignorenulls=True).over(ahead)).filter("__kind = 0")
    firsts = line.groupBy("__piece").agg(F.min_by("__next", F.when(F.col("__kind") == 1, F.col("__at"))).alias("__first"))
    after = Window.orderBy("__piece").rowsBetween(1, Window.unboundedFollowing)  # one row a piece
    later = firsts.select(F.col("__piece").alias("__p"), F.first("__first", ignorenulls=True).over(after).alias("__later"))
    found = inside.join(later, F.col("__piece") == F.col("__p"), "left").withColumn("__next", F.when(F.col("__at").isNotNull(), F.coalesce("__next", "__later")))
    return found.select("__row.*", *(F.col(f"__next.{c}").alias(c) for c in new))


def with_images(results: DataFrame, images: DataFrame) -> DataFrame:
    """Results beside the images of their names; results without one are left out."""
    return results.join(images.select("filename", "payload"), "filename")


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """How often each actual label (null among them) was predicted as which: actual, predicted, n."""
    return rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def accuracy(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: how many rows have an actual label, and the share of these that was predicted right; a null prediction is wrong."""
    right = F.count(F.when(F.col(actual) == F.col(predicted), 1))
    return rows.filter(F.col(actual).isNotNull()).agg(F.count("*").alias("n"), F.try_divide(right, F.count("*")).alias("accuracy"))


def widest_pairs(points: DataFrame, group: str, x: Column, y: Column) -> DataFrame:
    """group, n_points and the greatest distance between two of its points in the plane.

    The ends of a widest pair are corners of the hull, and the hull of all is that of the partial hulls. So each batch of
    rows sends its groups' corners on, and only those meet: first those of a share of the batches, then the corners of what is
    left; no group is held whole."""
    flat = points.select(F.col(group).alias("g"), x.cast("double").alias("x"), y.cast("double").alias("y")).filter("x is not null and y is not null")
    kind = dict(points.dtypes)[group]

    def corners(frames):
        for frame in frames:
            parts = [(g, len(f), *p) for g, f in frame.groupby("g", dropna=False) for p in [_spread(f[["x", "y"]].to_numpy())]]
            yield pd.DataFrame(parts, columns=["g", "n", "xs", "ys"])

    def widest(frame: pd.DataFrame) -> pd.DataFrame:
        ps = np.stack([np.concatenate(frame["xs"].tolist()), np.concatenate(frame["ys"].tolist())], axis=1)
        return pd.DataFrame([(frame["g"].iloc[0], int(frame["n"].sum()), shapes.diameter(ps)[0])], columns=[group, "n_points", "max_distance"])

    def fewer(frame: pd.DataFrame) -> pd.DataFrame:
        ps = np.stack([np.concatenate(frame["xs"].tolist()), np.concatenate(frame["ys"].tolist())], axis=1)
        return pd.DataFrame([(frame["g"].iloc[0], int(frame["n"].sum()), *_spread(ps))], columns=["g", "n", "xs", "ys"])

    schema = f"g {kind}, n long, xs array<double>, ys array<double>"
    partial = flat.mapInPandas(corners, schema).withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES)))
    partial = partial.groupBy("g", "share").applyInPandas(lambda frame: fewer(frame), schema)
    return partial.groupBy("g").applyInPandas(widest, f"{group} {kind}, n_points long, max_distance double")


def _spread(points: np.ndarray) -> tuple[list[float], list[float]]:
    corners = shapes.hull(points)
    return corners[:, 0].tolist(), corners[:, 1].tolist()
