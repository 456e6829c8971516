"""One-minute windows: counts by label, means, carried positions, the delay line and the correction for lost images.

Windows are half-open minutes of event time; minutes without arrivals have none. What orders windows across time runs on
one row per window (or control row), after aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidestream.functions import scalars
from tidestream.operators import joins

#: A window is emitted when this many more have closed; so long can control rows correct it.
DELAY = 10


def minute(at: str = "arrival") -> Column:
    return F.date_trunc("minute", F.col(at))


def label_counts(rows: DataFrame, label: str = "label", at: str = "arrival") -> DataFrame:
    """minute, label, n: only what occurs."""
    return rows.groupBy(minute(at).alias("minute"), label).agg(F.count("*").alias("n"))


def wide_counts(rows: DataFrame, labels: Sequence[str], label: str = "label", at: str = "arrival") -> DataFrame:
    """minute and a column for each label, 0 where it doesn't occur; others are not counted.

    The labels are given, so one pass with map-side sums does it."""
    return rows.groupBy(minute(at).alias("minute")).agg(*(F.count(F.when(F.col(label) == x, 1)).alias(x) for x in labels))


def means(rows: DataFrame, columns: dict[str, str], at: str = "arrival") -> DataFrame:
    """minute and the mean (3 places; null if there is none) of each column, under the name it is mapped to."""
    return rows.groupBy(minute(at).alias("minute")).agg(*(F.round(F.avg(c), 3).alias(name) for c, name in columns.items()))


def last_carried(rows: DataFrame, values: Sequence[str], at: str = "arrival", tie: str | None = None) -> DataFrame:
    """minute and the last non-null value of each column in it, or in the latest minute before that has one."""
    order = F.struct(*([at] if tie is None else [at, tie]))
    last = rows.groupBy(minute(at).alias("minute")).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), order)).alias(v) for v in values))
    line = Window.orderBy("minute").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return last.select("minute", *(F.last(v, ignorenulls=True).over(line).alias(v) for v in values))


def rates(rows: DataFrame, at: str = "arrival", unit: str = "minute") -> DataFrame:
    """window, images and images a second between the first and the last of each window."""
    return rows.groupBy(F.date_trunc(unit, F.col(at)).alias("window")).agg(F.count("*").alias("images"), scalars.rate(F.count("*"), F.min(F.col(at).cast("timestamp")), F.max(F.col(at).cast("timestamp"))).alias("rate"))


def delayed(windows: DataFrame, values: Sequence[str], delay: int = DELAY, order: str = "minute") -> DataFrame:
    """At each close, the window closed `delay` closes before: closed_at, then order and values of that one."""
    line = Window.orderBy(order)
    late = windows.select(F.col(order).alias("closed_at"), *(F.lag(c, delay).over(line).alias(c) for c in (order, *values)), F.row_number().over(line).alias("__n"))
    return late.filter(F.col("__n") > delay).drop("__n")


def sequenced(windows: DataFrame, order: str = "minute") -> DataFrame:
    """windows with win_seq: 1 for the first to close, and so on."""
    return windows.withColumn("win_seq", F.row_number().over(Window.orderBy(order)).cast("long"))


def control_sequence(controls: DataFrame, windows: DataFrame, at: str = "arrival", order: str = "minute") -> DataFrame:
    """controls with win_seq of the window that closes next after each arrives, and ctrl_seq, its place among all.

    windows: sequenced. Controls that arrive after the last window have none and are left out."""
    marks = windows.select(F.col(order).alias("__at"), F.lit(1).alias("__kind"), "win_seq")
    times = controls.select(minute(at).alias("__at"), F.lit(0).alias("__kind"), F.col(at).alias("__arrival")).distinct()
    both = marks.withColumn("__arrival", F.lit(None).cast(dict(times.dtypes)["__arrival"])).unionByName(times.withColumn("win_seq", F.lit(None).cast("long")))
    ahead = Window.orderBy("__at", "__kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = both.withColumn("win_seq", F.first("win_seq", ignorenulls=True).over(ahead)).filter("__kind = 0 and win_seq is not null")
    found = found.select("__arrival", "win_seq", F.row_number().over(Window.orderBy("__arrival")).cast("long").alias("ctrl_seq"))
    return controls.join(found, controls[at] == found["__arrival"]).drop("__arrival")


def corrections(control_rows: DataFrame, delay: int = DELAY) -> DataFrame:
    """win_seq, hits, misses: the latest control row with hits for each window.

    control_rows: win_seq of the window that closes with the control, ctrl_seq (their order), n (1..delay), hits, misses. Row n
    speaks of the window closed delay - n closes before."""
    aimed = control_rows.filter((F.col("hits") > 0) & F.col("misses").isNotNull()).select((F.col("win_seq") - delay + F.col("n")).alias("win_seq"), F.struct("ctrl_seq", "n", "hits", "misses").alias("c"))
    latest = aimed.filter("win_seq >= 1").groupBy("win_seq").agg(F.max_by("c", F.struct("c.ctrl_seq", "c.n")).alias("c"))
    return latest.select("win_seq", F.col("c.hits").alias("hits"), F.col("c.misses").alias("misses"))


def event_corrections(control_rows: DataFrame, windows: DataFrame, at: str = "arrival", order: str = "minute", delay: int = DELAY) -> DataFrame:
    """minute, hits, misses: the latest control row with hits for each minute, matched by time instead of by number of closes.

    control_rows: arrival, n (1..delay), hits, misses. A control stands at the minute of the window that closes next after it arrives; its row n
    speaks of the minute delay - n minutes before, whatever windows lie between. The two forms differ after gaps only, where this one is right."""
    good = control_rows.filter((F.col("hits") > 0) & F.col("misses").isNotNull())
    times = good.select(F.col(at).alias("__arrival"), minute(at).alias("__minute")).distinct()
    stands = joins.next_at(times, "__minute", windows.select(F.col(order).alias("__closes")), "__closes", "day").filter("__closes is not null")
    aimed = good.join(stands, good[at] == stands["__arrival"])
    back = F.timestamp_seconds(F.unix_micros("__closes") / 1_000_000 - 60 * (F.lit(delay) - F.col("n")))
    rows = aimed.select(back.alias("minute"), F.struct(F.col(at).alias("at"), "n", "hits", "misses").alias("c"))
    latest = rows.groupBy("minute").agg(F.max("c").alias("c"))
    return latest.select("minute", F.col("c.hits").alias("hits"), F.col("c.misses").alias("misses"))


def calendar(windows: DataFrame, counts: Sequence[str] = (), carried: Sequence[str] = (), order: str = "minute", unit: str = "day") -> DataFrame:
    """A row for every minute from the first window to the last: counts are 0 and carried values the last known where there is no window, other
    columns null; `idle` tells these minutes.

    Minutes are made where they are needed: one row per unit makes its own. Values are carried within a unit, and from unit to unit by one row
    for each, so no task orders all minutes."""
    rows = windows.withColumn("__unit", F.date_trunc(unit, order))
    ends = windows.agg(F.min(order).alias("first"), F.max(order).alias("last")).filter("first is not null")
    units = ends.select("first", "last", F.explode(F.sequence(F.date_trunc(unit, "first"), F.date_trunc(unit, "last"), F.expr(f"interval 1 {unit}"))).alias("__unit"))
    until = F.least(F.col("last"), F.col("__unit") + F.expr(f"interval 1 {unit}") - F.expr("interval 1 minute"))
    minutes = units.select("__unit", F.explode(F.sequence(F.greatest("first", "__unit"), until, F.expr("interval 1 minute"))).alias(order))
    out = minutes.join(rows.withColumn("__there", F.lit(True)), ["__unit", order], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts} | {"idle": F.col("__there").isNull()})
    if carried:
        last = rows.groupBy("__unit").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in carried))
        before = Window.orderBy("__unit").rowsBetween(Window.unboundedPreceding, -1)  # one row a unit
        known = units.select("__unit").join(last, "__unit", "left").select("__unit", *(F.last(c, ignorenulls=True).over(before).alias(f"__{c}") for c in carried))
        inside = Window.partitionBy("__unit").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in carried}).join(known, "__unit")
        out = out.withColumns({c: F.coalesce(c, f"__{c}") for c in carried})
    return out.select(order, *(c for c in windows.columns if c != order), "idle")


def corrected(windows: DataFrame, corrections_: DataFrame, labels: Sequence[str], every: int = 1, delay: int | None = DELAY, by: str = "win_seq") -> DataFrame:
    """The windows (sequenced, a count for each label) that have been corrected at least once, with hits, misses,
    totalCount and `<label>Count` concentrations beside `uncorrected_<label>Count`.

    delay: leave out the last windows, which haven't closed so many closes ago; None keeps them. by: what corrections are of."""
    rows = windows.join(corrections_, by)
    if delay is not None:
        last = windows.agg((F.max("win_seq") - delay).alias("__last"))
        rows = rows.join(F.broadcast(last), F.col("win_seq") <= F.col("__last")).drop("__last")  # one row
    total = sum((F.col(x) for x in labels[1:]), F.col(labels[0])) * every
    concentration = {x: scalars.concentration(F.col("hits"), F.col("misses"), F.lit(every), F.col(x)) for x in labels}
    rest = [c for c in rows.columns if c not in labels]
    return rows.select(*rest, total.cast("long").alias("totalCount"), *(F.col(x).alias(f"uncorrected_{x}Count") for x in labels), *(c.alias(f"{x}Count") for x, c in concentration.items()))


def accounted(records: DataFrame, least: float = 0.5) -> DataFrame:
    """Those corrected windows of whose images (hits and misses) more than a share was counted; windows without any are left out."""
    return records.filter(F.col("totalCount") > least * (F.col("hits") + F.col("misses")))


def payloads(records: DataFrame, key: str = "minute") -> DataFrame:
    """key and `payload`, each record as JSON."""
    return records.select(key, F.to_json(F.struct(*records.columns)).alias("payload"))
