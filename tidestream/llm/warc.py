"""WARC archives of pages, and the globally ordered index of what they hold.

Writing: one record per page, a response or, where an equal payload has been stored, a revisit that refers to it; Spark's
text writer makes archives of some records each, the blank line after each record being its line separator. Reading: Spark's text
reader gives each archive's lines as a stream, cut at blank lines, and a task puts them together again and parses records by their
lengths, holding one record at a time whatever the size of the archive; payloads are hashed anew. Index entries are sorted archive by
archive: local runs. Merging: entries are range-partitioned by URL key and time, into as many parts as keep each below PART_ENTRIES,
and within a partition a loser tree merges the runs that reach into it, each read block by block from its Arrow batches.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestream.llm import common as C

#: Payloads of fewer bytes are never revisits; records of an archive at most; entries (some 250 bytes each) that one task merges, and
#: those of a run that it has as Python rows at once.
LEAST_SHARED, RECORDS_PER_ARCHIVE, PART_ENTRIES, BLOCK = 100, 20_000, 400_000, 512
#: What stands after each record, and between the lines that the text reader gives.
GAP = b"\r\n\r\n"
#: Second 0 of a capture without a time of its own: page_id counts seconds from it.
EPOCH = 1_704_067_200
_INDEX = "run string, at long, url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(urn: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), urn.cast("string"), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """`value`: each page's record without its closing blank line. Null html: an empty payload; null url: an empty one;
    null page_id: the record has no identifier. Pages of one page_id are records of their own."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "").alias("url"), html.alias("html"))
    rows = rows.withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha2(F.col("html").cast("binary"), 256)})
    first = rows.filter(F.col("size") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    first = C.checkpointed(first.filter("copies > 1").select("digest", "first"))
    rows = C.left_join_small(rows, first, "digest", F.col("page_id"))
    again = F.coalesce((F.col("page_id") != F.col("first")) & (F.col("size") >= LEAST_SHARED), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, "html"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    captured = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _page(F.col("first"))))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        F.coalesce(line("WARC-Record-ID", _page(F.col("page_id"))), F.lit("")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", captured),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(again, revisit).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, folder: str) -> None:
    """Writes gzip-compressed archives to folder, which must be shared by driver and executors."""
    records(pages).write.option("lineSep", GAP.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(folder)


def url_key(url: str) -> str:
    """The URL with its host's labels reversed, lower case, without scheme, port, `www.` and fragment: sites sort together."""
    try:
        parts = urlsplit(url)
        host = re.sub(r"^www\d*\.", "", (parts.hostname or "").lower())
    except ValueError:
        return url.lower()
    tail = parts.path + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + (tail or "/").lower()


class Parser:
    """Records of an archive that comes line by line, lines being parted by GAP; one record is held at a time."""

    def __init__(self):
        self.headers: dict[str, str] | None = None
        self.lines: list[bytes] = []
        self.left, self.skip = 0, b""  # bytes of the block that are still to come; what is left of a GAP that began in a block's end

    def feed(self, line: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """(headers, block) of the record that ends with this line, if one does."""
        if self.headers is None:
            if not line.startswith(self.skip):
                raise ValueError("a record isn't followed by a blank line")
            head, self.skip = line[len(self.skip) :].decode().split("\r\n"), b""
            if head == [""]:
                return
            if not head[0].startswith("WARC/"):
                raise ValueError("no record begins where one should")
            self.headers = dict(x.split(": ", 1) for x in head[1:])
            self.left = int(self.headers["Content-Length"])
            return
        self.lines.append(line)
        self.left -= len(line) + len(GAP)
        if self.left < 0:
            block = GAP.join([*self.lines, b""])
            if block[self.left :] != GAP[: -self.left]:
                raise ValueError("a record is longer than it says")
            headers, self.headers, self.lines, self.skip = self.headers, None, [], GAP[-self.left :]
            yield headers, block[: self.left]


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed archive."""
    parser = Parser()
    for line in archive.split(GAP):
        yield from parser.feed(line)


def _entry(headers: dict[str, str], block: bytes) -> tuple:
    number = lambda name: int(x[10:-1]) if (x := headers.get(name)) else None
    if headers["WARC-Type"] == "response":
        cut = block.index(GAP) + len(GAP)
        size, digest = len(block) - cut, hashlib.sha256(memoryview(block)[cut:]).hexdigest()
    else:
        size, digest = int(re.search(rb"Content-Length: (\d+)", block)[1]), headers["WARC-Payload-Digest"][7:]
    return url_key(headers["WARC-Target-URI"]), headers["WARC-Date"], number("WARC-Record-ID"), size, digest, headers["WARC-Type"], number("WARC-Refers-To")


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


def _entries(batches):
    """Rows are an archive's path and a line of it; archives come one after the other."""
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string()}[t]) for n, t in (x.split() for x in _INDEX.split(", "))])
    last, parser, rows = None, Parser(), []

    def run():
        name = hashlib.md5(last.encode()).hexdigest()
        rows.sort(key=_order)
        for i in range(0, len(rows), 4096):
            columns = list(zip(*[(name, i + k, *r) for k, r in enumerate(rows[i : i + 4096])], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    for batch in batches:
        for path, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if path != last:
                yield from run() if rows else ()
                last, parser, rows = path, Parser(), []
            rows += [_entry(*record) for record in parser.feed(line.as_py())]
    yield from run() if rows else ()


def merge(runs: list[Iterable], key) -> Iterator:
    """k-way merge of sorted runs by a loser tree: each inner node keeps the loser of the match below it, so the next
    item costs one match per level."""
    k = len(runs)
    if not k:
        return
    sources = [iter(r) for r in runs]
    heads = [next(s, None) for s in sources]
    before = lambda a, b: heads[a] is not None and (heads[b] is None or (key(heads[a]), a) < (key(heads[b]), b))
    loser, winner = [0] * k, list(range(k))  # node n has the children 2n and 2n + 1; from k on they are the runs
    best = [0] * k + winner
    for n in range(k - 1, 0, -1):
        a, b = best[2 * n], best[2 * n + 1]
        best[n], loser[n] = (a, b) if before(a, b) else (b, a)
    top = best[1] if k > 1 else 0
    while heads[top] is not None:
        yield heads[top]
        heads[top] = next(sources[top], None)
        n = (top + k) // 2
        while n:
            if before(loser[n], top):
                loser[n], top = top, loser[n]
            n //= 2


def _merged(batches):
    """Rows come sorted by run and place in it; they stay Arrow batches but for a block of each run."""
    runs: dict[str, list[pa.RecordBatch]] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        names = batch.column(0).to_pylist()
        edge = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            runs.setdefault(names[a], []).append(batch.slice(a, b - a))

    def rows(parts: list[pa.RecordBatch]):
        for part in parts:
            for i in range(0, len(part), BLOCK):
                yield from zip(*(c.to_pylist() for c in part.slice(i, BLOCK).columns), strict=True)

    merged = merge([rows(parts) for parts in runs.values()], lambda r: _order(r[2:]))
    while out := list(itertools.islice(merged, 4096)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of all archives in folder, ordered by url_key, captured and page_id over all partitions."""
    lines = spark.read.option("lineSep", GAP.decode()).option("pathGlobFilter", "*.txt.gz").text(folder)
    entries = C.checkpointed(lines.select("_metadata.file_path", F.col("value").cast("binary")).mapInArrow(_entries, _INDEX))
    parts = max(C.shuffle_partitions(spark), -(-entries.count() // PART_ENTRIES))
    dealt = entries.repartitionByRange(parts, "url_key", "captured", "page_id").sortWithinPartitions("run", "at")
    return dealt.mapInArrow(_merged, _INDEX).drop("run", "at")


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages to archives (in the shared folder, unless another is given) and returns what they hold, in index
    order: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured.

    Of records with equal payloads of LEAST_SHARED bytes or more, those of the smallest page_id are responses."""
    spark = pages.sparkSession
    if folder is None:
        folder = f"{C.folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    return index(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")
