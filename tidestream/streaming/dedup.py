"""Things that come twice in a stream: packets sent again, messages delivered again after a crash."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: How far apart two of a kind may be and still be told.
WITHIN = "10 minutes"


def packets_once(packets: DataFrame, within: str = WITHIN) -> DataFrame:
    """The first packet of each part of each file; others that come within the time are dropped, and the state forgets a part after it."""
    return packets.withWatermark("arrival", within).dropDuplicatesWithinWatermark(["field", "unique_id", "part"])


def messages_once(messages: DataFrame, key: str = "key", at: str = "received", within: str = WITHIN) -> DataFrame:
    """The receiver's side of the outbox: a message that is sent again, as may happen after a crash, is delivered once."""
    return messages.withWatermark(at, within).dropDuplicatesWithinWatermark([key])
