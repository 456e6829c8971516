"""Benchmark decontamination by pigeonhole edit matching.

An item of L characters may differ in k = floor(rate * L) edits. Cut into k + 1 pieces, at least one piece of it stands
unchanged wherever the item occurs within k edits: each exact piece hit (one automaton for all pieces of a block of
items) gives a stretch of the document in which Myers' bit-parallel distance then finds the best end. Letter case and
the kind and number of white space do not count. An item too short for any edit is found as words only: where it begins or ends with a letter
or digit, none may stand beside it, so "art" isn't in "party".

The items are the query set: they are taken in blocks of at most about BLOCK_ITEMS, each block against all documents. More
than one block are taken one after the other, each one's matches written down before the next is sent out, so that the driver and the
executors hold one block at a time.
"""

from __future__ import annotations

import functools

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestream.llm import common as C

#: Edits allowed for a character of an item, and items of which one block's automaton is made.
RATE, BLOCK_ITEMS = 0.05, 5000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def cut(item: str, rate: float) -> tuple[int, list[tuple[int, str]]]:
    """The error budget, and one piece more than that with their offsets."""
    k = int(rate * len(item))
    edges = [len(item) * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def least_distance(item: str, text: str) -> int:
    """The least edit distance between item and any stretch of text (Myers' bit vectors, one integer for the item)."""
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = score
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        up = (mh << 1 & full) | ~(xv | ph) & full
        down = ph & xv
        if score < best:
            best = score
    return best


def stands(text: str, begin: int, end: int) -> bool:
    """Whether no word of text is cut at begin or end."""
    cuts = lambda at: 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()
    return not cuts(begin) and not cuts(end)


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, n) for i, t in items if (n := normal(t))]
        self.budget: list[int] = []
        self.automaton = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for x, (_, n) in enumerate(self.items):
            k, parts = cut(n, rate)
            self.budget.append(k)
            for at, piece in parts:
                pieces.setdefault(piece, []).append((x, at))
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, least distance, budget) of the items within their budget somewhere in the text."""
        if not self.items or not text:
            return []
        text = normal(text)
        begins: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for x, at in where:
                begins.setdefault(x, set()).add(end + 1 - size - at)
        out = []
        for x, found in begins.items():
            (item_id, item), k = self.items[x], self.budget[x]
            if not k:
                if any(stands(text, b, b + len(item)) for b in found):
                    out.append((item_id, 0, 0))
                continue
            best = k + 1
            stretch: list[int] = []
            for b in [*sorted(found), None]:
                if stretch and (b is None or b - stretch[-1] > 2 * k + 1):
                    best = min(best, least_distance(item, text[max(0, stretch[0] - k) : max(0, stretch[-1] + len(item) + k)]))
                    stretch = []
                if b is not None:
                    stretch.append(b)
                if best == 0:
                    break
            if best <= k:
                out.append((item_id, best, k))
        return out


_MATCHERS: dict[tuple, Matcher] = {}


def _matches(batches, items, rate: float):
    key = (items.value, rate)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(list(items.value), rate)
    matcher = _MATCHERS[key]
    for batch in batches:
        rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in matcher.matches(t)]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "item_id", "distance", "budget"])


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, distance, budget): the items found in each document within their budget, with the least distance.

    Null or blank texts and items match nothing. An item of fewer than 1 / rate characters has no budget and must stand at the edges of words. Rows with equal ids are matched each, and equal results returned
    once. Other columns of docs and items are not looked at."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("trim(text) != ''")
    blocks = max(1, -(-items.count() // block_items))
    parts = []
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        held = spark.sparkContext.broadcast(tuple(sorted((tuple(r) for r in block.collect()), key=str)))
        part = docs.select("doc_id", "text").mapInArrow(lambda it, held=held: _matches(it, held, rate), "doc_id long, item_id long, distance int, budget int")
        if blocks > 1:
            part = C.checkpointed(part.distinct())
            held.unpersist()
        parts.append(part)
    return functools.reduce(DataFrame.unionByName, parts).distinct()


def without_matches(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs that hold no item. Each row is judged by itself, whatever its doc_id: rows are numbered in a checkpoint. Columns stay,
    whatever their names."""
    rows = C.checkpointed(docs.select(F.struct(*docs.columns).alias("rest"), F.monotonically_increasing_id().alias("row")))
    found = matches(rows.select(F.col("row").alias("doc_id"), "rest.text"), items, **options).select(F.col("doc_id").alias("found")).distinct()
    left = rows.join(found, F.col("row") == F.col("found"), "left_anti")
    return left.select(*(F.col("rest").getField(c).alias(c) for c in docs.columns))
