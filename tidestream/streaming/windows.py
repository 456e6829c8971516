"""Windows of a stream: closed minutes, then the delay line with its corrections.

Two queries, joined by a table of closed windows: many rows are aggregated by minute under a watermark; then one row a minute
passes a delay line under a single key. Batch and stream give the same windows, but for the last ones, which stay open
or undelayed until something later arrives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidestream.functions.scalars import FLOW
from tidestream.operators.windows import DELAY

_EMITTED = "minute timestamp, record string"


def closed_windows(rows: DataFrame, labels: Sequence[str], means: dict[str, str] | None = None, lateness: str = "0 seconds", label: str = "label", at: str = "arrival") -> DataFrame:
    """minute, a count for each label and the means, of each minute that the watermark has passed. at: a timestamp with a zone."""
    counts = [F.count(F.when(F.col(label) == x, 1)).alias(x) for x in labels]
    averages = [F.round(F.avg(c), 3).alias(name) for c, name in (means or {}).items()]
    windows = rows.withWatermark(at, lateness).groupBy(F.window(at, "1 minute").alias("w")).agg(*counts, *averages)
    return windows.select(F.col("w.start").alias("minute"), *[c for c in windows.columns if c != "w"])


def _line(labels: Sequence[str], every: int, delay: int):
    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        line, waiting = ([json.loads(x) for x in part] for part in (state.get if state.exists else ([], [])))
        rows = pd.concat(list(frames)).sort_values(["at", "kind", "arrival"], kind="stable")
        out = []
        for row in rows.itertuples():
            if row.kind == 0:
                waiting.append(json.loads(row.record))
                continue
            line = [*line, {"at": row.at.isoformat(), "record": json.loads(row.record)}][-delay - 1 :]
            for control in waiting:
                for n, (hits, misses) in enumerate(control, 1):
                    k = len(line) - 1 - (delay - n)
                    if 0 <= k < len(line) and hits and hits > 0 and misses is not None:
                        line[k]["hits"], line[k]["misses"] = hits, misses
            waiting = []
            if len(line) > delay and "hits" in line[0]:
                out.append((pd.Timestamp(line[0]["at"]), json.dumps(_record(line[0], labels, every))))
        state.update(([json.dumps(x) for x in line], [json.dumps(x) for x in waiting]))
        if out:
            yield pd.DataFrame(out, columns=["minute", "record"])

    return advance


def _record(held: dict, labels: Sequence[str], every: int) -> dict:
    record, hits, misses = dict(held["record"]), held["hits"], held["misses"]
    counts = {x: record.pop(x) for x in labels}
    record |= {"hits": hits, "misses": misses, "totalCount": every * sum(counts.values())}
    record |= {f"uncorrected_{x}Count": n for x, n in counts.items()}
    return record | {f"{x}Count": round((hits + misses) / hits * every * n / FLOW, 3) for x, n in counts.items()}


def emitted(windows: DataFrame, controls: DataFrame, labels: Sequence[str], every: int = 1, delay: int = DELAY) -> DataFrame:
    """minute and record (JSON) of each window, `delay` closes after its own, if it has been corrected.

    windows: minute, counts, other columns. controls: arrival, rows (array of hits, misses structs in order, as many as the delay).
    A control takes effect when the window of its minute, or the next there is, closes. The state is one row: the last windows."""
    others = [c for c in windows.columns if c != "minute"]
    a = windows.select(F.col("minute").alias("at"), F.lit(1).alias("kind"), F.col("minute").alias("arrival"), F.to_json(F.struct(*others), {"ignoreNullFields": "false"}).alias("record"))
    pairs = F.transform("rows", lambda r: F.array(r["hits"], r["misses"]))
    b = controls.filter(F.size("rows") == delay).select(F.date_trunc("minute", "arrival").alias("at"), F.lit(0).alias("kind"), "arrival", F.to_json(pairs, {"ignoreNullFields": "false"}).alias("record"))
    both = a.unionByName(b).withColumn("line", F.lit(0))
    return both.groupBy("line").applyInPandasWithState(_line(tuple(labels), every, delay), _EMITTED, "line array<string>, waiting array<string>", "append", GroupStateTimeout.NoTimeout)
