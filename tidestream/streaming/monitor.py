"""What running queries do, in a rotating log: their progress and the counts that they observe."""

from __future__ import annotations

import json
import logging
import logging.handlers

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidestream import schemas as S
from tidestream.sources import packets

#: When a log file is closed, and how many older ones stay.
LOG_WHEN, LOG_FILES = "midnight", 21


def logger(path: str, name: str = "tidestream") -> logging.Logger:
    """A logger to a file that is rotated each midnight, on the driver."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.handlers.TimedRotatingFileHandler(path, when=LOG_WHEN, backupCount=LOG_FILES)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
    return log


def counted(datagrams: DataFrame, name: str = "datagrams") -> DataFrame:
    """datagrams, observed under `name`: how many came, how many are malformed, how many have a part out of range."""
    bad = packets.is_malformed()
    out_of_range = ~bad & (packets.part_of() >= S.MOST_PARTS)
    return datagrams.observe(name, F.count(F.lit(1)).alias("came"), F.count(F.when(bad, 1)).alias("malformed"), F.count(F.when(out_of_range, 1)).alias("rejected"))


class Progress(StreamingQueryListener):
    """Logs each micro-batch that had input (name, rows, rate, observed counts), and how queries start and end."""

    def __init__(self, log: logging.Logger):
        self.log = log

    def onQueryStarted(self, event) -> None:
        self.log.info("started %s", event.name or event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            observed = {k: v.asDict() for k, v in p.observedMetrics.items()}
            self.log.info("batch %s", json.dumps({"query": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, **observed}))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        (self.log.error if event.exception else self.log.info)("ended %s %s", event.id, event.exception or "")
