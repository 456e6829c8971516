"""How filters act on each other in every order that they could be applied in, in DataFrame functions only.

Each document's failures make a mask of five bits. Four come from its text alone; the fifth, being a copy, from a grouping by text
that gives each text its smallest doc_id: a document that isn't its text's smallest is a copy. The texts' smallest documents go
back by doc_id, so a text of however many copies is one row there and its copies spread over all tasks. A mask histogram, 32 cells
for each part at most, then holds all that any order can tell: each order's steps are sums of cells.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidestream.llm import common as C

FILTERS = "ABCDE"
#: Failures that a text shows by itself: too few words, too few distinct ones (%), too many capitals (%), a symbol.
WORDS, DISTINCT, CAPITALS, SYMBOL = 100, 80, 10, "[#$%&*|]"
COPY = 1 << FILTERS.index("E")


def failures(text: Column) -> Column:
    """The mask of the filters A to D for a text that isn't null."""
    words = C.word_array(text)

    def mask(w: Column) -> Column:
        n = F.size(w)
        failed = (
            n < WORDS,
            100 * F.size(F.array_distinct(w)) < DISTINCT * n,
            100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITALS * F.length(text),
            F.regexp_like(text, F.lit(SYMBOL)),
        )
        return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed[1:], 1)), F.when(failed[0], 1).otherwise(0))

    return F.get(F.transform(F.array(words), mask), 0)  # the words are made once


def masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, mask, n: how many rows of a doc_id and part fail the same filters.

    Null text: empty; it fails A and, if it isn't the first empty one, E. A null doc_id has none smaller, and makes nothing a copy. Rows of
    one doc_id and text are no copies of each other."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("digest"), failures(text).alias("mask"))
    rows = C.checkpointed(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")))
    first = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = rows.filter("doc_id is not null").join(first, ["doc_id", "digest"], "left")
    known = known.select("doc_id", "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + COPY).alias("mask"), "n")
    return known.unionByName(rows.filter("doc_id is null").select("doc_id", "part", "mask", "n"))


def histogram(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents of each cell, and those among them that some label calls good, or toxic."""
    said = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic"))
    both = masks(docs, part).join(said, "doc_id", "left")
    count = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0))
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("is_good").alias("good"), count("is_toxic").alias("toxic"))


def audited(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    No documents give no rows. Labels of documents that aren't there count for nothing, several of one document together. Other columns
    are not looked at."""
    cells = histogram(docs, labels, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    orders = F.array(*(F.lit("".join(o)) for o in itertools.permutations(FILTERS)))
    steps = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.array(*map(F.lit, range(1, len(FILTERS) + 1)))))
    bits = F.transform(F.split("filter_order", ""), lambda c: F.element_at(F.create_map(*(F.lit(x) for k, f in enumerate(FILTERS) for x in (f, 1 << k))), c))
    earlier = F.aggregate(F.slice(bits, 1, F.col("step") - 1), F.lit(0), lambda a, b: a + b)
    steps = steps.withColumns({"own": F.get(bits, F.col("step") - 1), "earlier": earlier})
    own, before = F.col("own"), F.col("earlier")

    def total(of: str, when) -> Column:
        return F.aggregate(F.filter("cells", lambda c: when(c["mask"])), F.lit(0).cast("long"), lambda a, c: a + c[of])

    fails = lambda m: m.bitwiseAND(own) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~gone(m)
    rows = steps.select(
        *("part", "filter_order", "step", "own"),
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")
