"""Every n-th image of a stream, and images in batches that are released when they are full or their minute closes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidestream.streaming import state

#: Images of a batch, how late one may be, and minutes of which the state is kept together where images are only passed on.
BATCH, LATENESS, TOGETHER = 255, "1 minute", 60


class Counter(StatefulProcessor):
    """Counts a sequence's images; those whose number is a multiple of n pass, with it."""

    def __init__(self, n: int, order: Sequence[str]):
        self.n, self.order = n, list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = self.count.get()[0] if self.count.exists() else 0
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable", na_position="first")
        frame["rn"] = range(before + 1, before + 1 + len(frame))
        self.count.update((before + len(frame),))
        yield frame[frame["rn"] % self.n == 0]

    def close(self) -> None:
        pass


def every_nth(images: DataFrame, n: int, order: Sequence[str] = ("arrival", "filename"), key: str | None = None) -> DataFrame:
    """Every n-th row of a stream with its number `rn`: by order within a micro-batch, and batch after batch, across restarts too.

    key: a column (the instrument) of which each value is counted by itself, side by side. Without one all are one sequence, which one task
    counts at a camera's pace; the state is a number."""
    state.on_rocks(images.sparkSession)
    kept = T.StructType([*images.schema.fields, T.StructField("rn", T.LongType())])
    keyed = images.withColumn("__key", F.lit("") if key is None else F.col(key).cast("string"))
    return keyed.groupBy("__key").transformWithStateInPandas(Counter(n, order), kept, "append", "None")


#: Of some minutes: their begins, how many images of each wait, how many of its batches are out; and when the next one closes, in milliseconds.
_COUNTS = "minutes array<long>, waiting array<long>, released array<long>, timer long"


class Batcher(StatefulProcessor):
    """Keyed by some minutes in a row and share: images of a minute (its begin in microseconds) wait until there are `size`, or until the minute closes."""

    def __init__(self, size: int, order: Sequence[str], columns: T.StructType, function: Callable[[pd.DataFrame], pd.DataFrame] | None):
        self.size, self.order, self.columns, self.function = size, list(order), columns, function
        self.kept = [*columns.names, "minute__us"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", T.StructType([*self.columns.fields, T.StructField("minute__us", T.LongType())]))
        self.counts = handle.getValueState("counts", _COUNTS)

    def _counted(self) -> tuple[dict[int, tuple[int, int]], int | None]:
        """Waiting images and released batches by minute, and the timer that is set."""
        if not self.counts.exists():
            return {}, None
        minutes, waiting, released, timer = self.counts.get()
        return dict(zip(minutes, zip(waiting, released, strict=True), strict=True)), timer

    def _count(self, found: dict[int, tuple[int, int]], timer: int | None) -> None:
        """Keeps the counts of open minutes, and has the timer at the end of the first."""
        if not found:
            self.counts.clear()
            return
        first = min(found) // 1000 + 60_000
        if timer != first:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        self.counts.update((list(found), [x[0] for x in found.values()], [x[1] for x in found.values()], first))

    def _waiting(self) -> pd.DataFrame:
        return pd.DataFrame([tuple(r) for r in self.held.get()], columns=self.kept)

    def _released(self, rows: pd.DataFrame, batch: pd.Series) -> Iterator[pd.DataFrame]:
        """The function runs on each batch; without one, the batches go out together."""
        parts = [((rows["minute__us"], batch), rows)] if self.function is None else rows.groupby([rows["minute__us"], batch])
        for (minute, number), part in parts:
            out = part[self.columns.names].reset_index(drop=True)
            out = out if self.function is None else self.function(out)
            out.insert(0, "batch", number if self.function else number.to_numpy())
            out.insert(0, "minute", pd.Timestamp(int(minute), unit="us") if self.function else pd.to_datetime(minute.to_numpy(), unit="us"))
            yield out

    def _dealt(self, rows: pd.DataFrame, found: dict[int, tuple[int, int]], closed: set[int]) -> Iterator[pd.DataFrame]:
        """Releases full batches, and what waits of closed minutes; the rest is held, and found tells what is."""
        by = rows.groupby("minute__us")["minute__us"]
        at, n = by.cumcount(), by.transform("size")
        out = at < n.where(rows["minute__us"].isin(closed), n // self.size * self.size)
        before = rows["minute__us"].map({m: r for m, (_, r) in found.items()})
        if out.any():
            yield from self._released(rows[out], (before + at // self.size)[out])
        for m, k in by.size().items():
            found[m] = (k % self.size, found[m][1] + k // self.size)
        for m in closed:
            found.pop(m, None)
        rest = rows[~out]
        if len(rest):
            self.held.put(_tuples(rest))
        else:
            self.held.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        found, timer = self._counted()
        new = pd.concat(list(rows))[self.kept].sort_values(self.order, kind="stable", na_position="first")
        held = any(waiting for waiting, _ in found.values())
        for m, k in new["minute__us"].value_counts().items():
            waiting, released = found.get(int(m), (0, 0))
            found[int(m)] = (waiting + int(k), released)
        if all(waiting < self.size for waiting, _ in found.values()):
            self.held.appendList(_tuples(new))
        else:
            yield from self._dealt(pd.concat([self._waiting(), new], ignore_index=True) if held else new.reset_index(drop=True), found, set())
        self._count(found, timer)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Closes all minutes that the watermark has passed."""
        found, _ = self._counted()
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        closed = {m for m in found if m // 1000 + 60_000 <= passed}
        if any(waiting for waiting, _ in found.values()):
            yield from self._dealt(self._waiting(), found, closed)
        self._count({m: x for m, x in found.items() if m not in closed}, None)

    def close(self) -> None:
        pass


def _tuples(frame: pd.DataFrame) -> list[tuple]:
    return list(frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None))


def batched(
    images: DataFrame, size: int = BATCH, lateness: str = LATENESS, at: str = "arrival", order: Sequence[str] = ("arrival", "filename"), shares: int = 1, function: Callable[[pd.DataFrame], pd.DataFrame] | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """minute, batch (from 0 in its minute) and the rows of each batch as it is released: when `size` images of a minute wait, or when the watermark
    passes the minute's end. Each image is in one batch, and later ones than `lateness` in none.

    function: run once on each released batch (a model on its images), giving rows of `schema`; without one the rows come as they are. shares:
    over how many tasks a minute's images are dealt, each with batches of its own. The state holds fewer than `size` images of an open minute a share.
    Work on images is dealt by minute; without a function, when nothing is to be done on them, an hour's minutes go together."""
    spark = images.sparkSession
    state.on_rocks(spark)
    columns = images.schema
    out = T.StructType([T.StructField("minute", T.TimestampType()), T.StructField("batch", T.LongType()), *(schema or columns).fields])
    marked = images.withWatermark(at, lateness).withColumns({"minute__us": F.unix_micros(F.date_trunc("minute", F.col(at))), "__share": F.pmod(F.xxhash64(*order), F.lit(shares))})
    together = F.floor(F.col("minute__us") / (60_000_000 * (1 if function else TOGETHER)))
    return marked.withColumn("__minutes", together).groupBy("__minutes", "__share").transformWithStateInPandas(Batcher(size, order, columns, function), out, "append", "EventTime")
