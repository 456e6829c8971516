"""Files put together from a stream of packets: of each file, state by part.

A batch writes the parts that came with it and one small row, and reads the others only when the file is complete; a file whose packets
come in one batch leaves that row alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidestream import schemas as S
from tidestream.sources import packets as P
from tidestream.streaming import state

_FILE = "filename string, payload binary, arrival timestamp"
#: Of a file: its total, a bit for each part that is there, whether it is out, the arrival of its last packet in microseconds.
_HEAD = "total int, parts binary, done boolean, last long"
_PART = "tag int, body binary, at long"
#: Minutes after a file's last packet when it is forgotten, complete or not, and how late a packet may be.
GIVE_UP_MINUTES, LATENESS = 10, "1 minute"


class Assembler(StatefulProcessor):
    """Keyed by slot and file. Packets of a part replace each other by arrival; a file is given once, when all parts below its total are there."""

    def __init__(self, give_up_minutes: float):
        self.give_up = int(give_up_minutes * 60_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", _HEAD)
        self.parts = handle.getMapState("parts", "part int", _PART)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        total, have, done, before = self.head.get() if self.head.exists() else (0, b"", False, -1)
        bits, last = int.from_bytes(have, "little"), before
        new: dict[int, tuple[int, bytes, int]] = {}
        for frame in rows:
            for row in frame.itertuples():
                part, at = int(row.part), int(row.at)
                last = max(last, at)
                if done or part >= S.MOST_PARTS:
                    continue
                total = max(total, int(row.total_parts))
                other = new.get(part) or (self.parts.getValue((part,)) if bits >> part & 1 else None)
                if other is None or other[2] <= at:
                    new[part] = (int(row.tag), bytes(row.body), at)
                    bits |= 1 << part
        below = (1 << total) - 1
        if not done and total > 0 and bits & below == below:
            yield self._file({k[0]: v for k, v in self.parts.iterator()} | new if self.parts.exists() else new, total, last)
            self.parts.clear()
            done = True
        elif not done:
            for part, value in new.items():
                self.parts.updateValue((part,), value)
        self.head.update((total, bits.to_bytes(S.MOST_PARTS // 8, "little"), done, last))
        if last != before:
            if before >= 0:
                self.handle.deleteTimer(before // 1000 + self.give_up)
            self.handle.registerTimer(last // 1000 + self.give_up)

    def _file(self, parts: dict[int, tuple], total: int, last: int) -> pd.DataFrame:
        held = {k: parts[k] for k in sorted(parts) if k < total}
        names = [bytes(v[1]) for v in held.values() if v[0] == P.TAG_NAME]
        name = names[0].decode("utf-8", "replace").replace("\\", "/").rpartition("/")[2] if names else None
        payload = b"".join(bytes(v[1]) for k, v in held.items() if k >= 1)
        return pd.DataFrame({"filename": [name], "payload": [payload], "arrival": [pd.Timestamp(last, unit="us")]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.head.clear()
        self.parts.clear()
        return iter([])

    def close(self) -> None:
        pass


def reassembled(packets: DataFrame, give_up_minutes: float = GIVE_UP_MINUTES, lateness: str = LATENESS) -> DataFrame:
    """filename, payload, arrival (of the last packet) of each file as its last part comes in, once: the files that the batch form gives,
    if a file's packets come within give_up_minutes of each other.

    Time is that of arrivals, so a restart forgets nothing and gives the same. A file whose packets are too late by
    `lateness` loses them. State is spread by slot and file, and bounded by what arrives in give_up_minutes."""
    state.on_rocks(packets.sparkSession)
    rows = packets.withWatermark("arrival", lateness).select("field", F.col("unique_id").cast("string").alias("unique_id"), "part", "total_parts", "tag", "body", "arrival", F.unix_micros("arrival").alias("at"))
    return rows.groupBy("field", "unique_id").transformWithStateInPandas(Assembler(give_up_minutes), _FILE, "append", "EventTime")
