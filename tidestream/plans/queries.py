"""Queries of the engine's operators over the driver's tables, each beside the SQL that must give the same rows.

The tables hold no images; events stand in for arrivals, conversations for packets, embeddings for scores and pixels.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidestream import schemas as S
from tidestream.functions import images, labels, scalars, tiff
from tidestream.operators import joins, reassembly, windows
from tidestream.sources import bins, checkpoints, files, quarantine
from tidestream.sources import packets as P
from tidestream.streaming import reassembly as stream_files
from tidestream.streaming import sampling

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
#: Windows between two control files of the queries, and what stands in for patterns of labels.
CONTROL_EVERY = 5
PATTERNS = (("a*", "A"), ("b*", "B"), ("blue*", "never"), ("*", "rest"))


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(at: Column | str) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


# --- counts and windows ------------------------------------------------------------------------------------------

_M = "strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S')"


@query(f"SELECT {_M} AS minute, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def minute_label_counts(spark, sf_dir):
    return windows.label_counts(table(spark, sf_dir, "events"), "event_type", "ts").withColumn("minute", _text("minute"))


_COUNTS = ", ".join(f"count(*) FILTER (event_type = '{x}') AS \"{x}\"" for x in EVENT_TYPES)


@query(f"SELECT {_M} AS minute, {_COUNTS} FROM events GROUP BY 1")
def minute_label_wide(spark, sf_dir):
    return windows.wide_counts(table(spark, sf_dir, "events"), EVENT_TYPES, "event_type", "ts").withColumn("minute", _text("minute"))


@query(f"SELECT {_M} AS minute, round(avg(value), 3) AS mean_value FROM events GROUP BY 1")
def minute_mean_value(spark, sf_dir):
    return windows.means(table(spark, sf_dir, "events"), {"value": "mean_value"}, "ts").withColumn("minute", _text("minute"))


@query("SELECT 'pi-' || strftime(ts, '%Y-%m-%d-%H-') || (minute(ts) // 10) || '0.bin' AS bin, count(*) AS n FROM events GROUP BY 1")
def ten_minute_bins(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(scalars.bin_name(F.col("ts")).alias("bin")).agg(F.count("*").alias("n"))


@query(
    f"""WITH w AS (SELECT {_M} AS minute, count(*) AS n FROM events GROUP BY 1),
    d AS (SELECT minute AS closed_at, lag(minute, 10) OVER (ORDER BY minute) AS minute, lag(n, 10) OVER (ORDER BY minute) AS n FROM w)
    SELECT * FROM d WHERE minute IS NOT NULL"""
)
def delayed_windows(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy(windows.minute("ts").alias("minute")).agg(F.count("*").alias("n"))
    return windows.delayed(counts, ["n"]).withColumns({"closed_at": _text("closed_at"), "minute": _text("minute")})


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS \"window\", count(*) AS images, round(count(*)::double / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::double), 9) AS rate FROM events GROUP BY 1")
def window_rate(spark, sf_dir):
    rate = F.coalesce(F.round("rate", 9), F.lit(float("inf")))  # an hour of one instant: the operator gives null, a quotient by zero seconds is infinite
    return windows.rates(table(spark, sf_dir, "events"), "ts", "hour").withColumns({"window": _text("window"), "rate": rate})


@query(
    f"""WITH w AS (SELECT {_M} AS minute, arg_max(value, event_id) FILTER (event_type = 'purchase' AND value IS NOT NULL) AS v FROM events GROUP BY 1)
    SELECT minute, last_value(v IGNORE NULLS) OVER (ORDER BY minute ROWS UNBOUNDED PRECEDING) AS last_purchase FROM w"""
)
def last_value_carry(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("last_purchase", F.when(F.col("event_type") == "purchase", F.col("value")))
    return windows.last_carried(rows, ["last_purchase"], "ts", "event_id").withColumn("minute", _text("minute"))


@query("WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events) SELECT event_id, rn FROM r WHERE rn % 7 = 0")
def subsample_nth(spark, sf_dir):
    return reassembly.every_nth(table(spark, sf_dir, "events").select("event_id", "ts"), 7, ["ts", "event_id"], F.date_trunc("hour", "ts")).select("event_id", F.col("rn").cast("long").alias("rn"))


@query(
    """WITH r AS (SELECT date_trunc('hour', ts) AS h, value, (row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) - 1) // 5 AS batch FROM events)
    SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS hour, batch::bigint AS batch, count(*) AS n FROM r GROUP BY 1, 2"""
)
def micro_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("ts", "event_id", F.date_trunc("hour", "ts").alias("hour"))
    return reassembly.micro_batches(rows, 5, ["hour"], ["ts", "event_id"]).groupBy(_text("hour").alias("hour"), F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"))


# --- correction --------------------------------------------------------------------------------------------------


def _sequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes with counts by type and their place: a small table, written once as it is read several times."""
    return checkpoints.checkpointed(windows.sequenced(windows.wide_counts(table(spark, sf_dir, "events"), EVENT_TYPES, "event_type", "ts")))


def _controls(sequenced: DataFrame) -> DataFrame:
    """A control text after each CONTROL_EVERY-th window: of each of the last ten windows its events but errors, and its errors
    and age."""
    first = (F.ceil(F.col("win_seq") / CONTROL_EVERY) * CONTROL_EVERY).cast("long")
    steps = F.filter(F.array(*[first + CONTROL_EVERY * k for k in range(windows.DELAY // CONTROL_EVERY)]), lambda c: c <= F.col("win_seq") + windows.DELAY - 1)
    aimed = sequenced.withColumn("ctrl", F.explode(steps)).select("ctrl", "win_seq", _hits().alias("hits"), (F.col("error") + F.col("ctrl") - F.col("win_seq")).alias("misses"))
    line = F.struct("win_seq", F.concat_ws(",", "hits", "misses").alias("line"))
    return aimed.groupBy(F.col("ctrl").alias("win_seq")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("text"))


def _hits() -> Column:
    return F.col("click") + F.col("purchase") + F.col("signup") + F.col("view")


_WINDOWS = f"""w AS (SELECT date_trunc('minute', ts) AS m, {_COUNTS}, count(*) FILTER (event_type <> 'error') AS h, row_number() OVER (ORDER BY date_trunc('minute', ts)) AS win_seq FROM events GROUP BY 1),
    k AS (SELECT ctrl, win_seq - ctrl + 10 AS n, win_seq, h AS hits, error + ctrl - win_seq AS misses FROM (SELECT *, unnest([(win_seq + 4) // 5 * 5, (win_seq + 4) // 5 * 5 + 5]) AS ctrl FROM w) WHERE ctrl <= win_seq + 9),
    c AS (SELECT ctrl FROM k GROUP BY 1 HAVING count(*) = 10),
    a AS (SELECT k.* FROM k JOIN c USING (ctrl) WHERE ctrl <= (SELECT max(win_seq) FROM w)),
    l AS (SELECT win_seq, arg_max(hits, ctrl) AS hits, arg_max(misses, ctrl) AS misses FROM a WHERE hits > 0 GROUP BY 1)"""


@query(f"WITH {_WINDOWS} SELECT ctrl AS win_seq, n::int AS n, hits, misses FROM a")
def control_rows(spark, sf_dir):
    found = _sequenced(spark, sf_dir)
    last = F.broadcast(found.agg(F.max("win_seq").alias("last")))  # one row
    rows = files.control_rows(_controls(found)).join(last, F.col("win_seq") <= F.col("last"))
    return rows.select("win_seq", "n", "hits", "misses")


def _corrected(found: DataFrame) -> DataFrame:
    rows = files.control_rows(_controls(found)).withColumn("ctrl_seq", F.col("win_seq"))
    last = F.broadcast(found.agg(F.max("win_seq").alias("last")))  # one row
    return windows.corrections(rows.join(last, F.col("win_seq") <= F.col("last")))


_OUT = ", ".join(f'"{x}" AS "uncorrected_{x}Count", round((hits + misses)::double / hits * 1 * "{x}" / 34, 3) AS "{x}Count"' for x in EVENT_TYPES)


@query(
    f"""WITH {_WINDOWS} SELECT strftime(m, '%Y-%m-%d %H:%M:%S') AS minute, win_seq, hits, misses, (click + error + purchase + signup + view)::bigint AS "totalCount", {_OUT}
    FROM w JOIN l USING (win_seq) WHERE win_seq <= (SELECT max(win_seq) FROM w) - 10"""
)
def positional_correction(spark, sf_dir):
    """Control rows matched to the windows closed so many closes ago; the last correction counts."""
    found = _sequenced(spark, sf_dir)
    return windows.corrected(found, _corrected(found), EVENT_TYPES).withColumn("minute", _text("minute"))


@query(f"WITH {_WINDOWS} SELECT win_seq FROM w JOIN l USING (win_seq) WHERE win_seq <= (SELECT max(win_seq) FROM w) - 10 AND click + error + purchase + signup + view > 0.2 * (hits + misses)")
def accounted_windows(spark, sf_dir):
    found = _sequenced(spark, sf_dir)
    return windows.accounted(windows.corrected(found, _corrected(found), EVENT_TYPES), 0.2).select("win_seq")


@query(f"WITH {_WINDOWS} SELECT win_seq, l.hits IS NOT NULL AND win_seq <= (SELECT max(win_seq) FROM w) - 10 AS emitted FROM w LEFT JOIN l USING (win_seq)")
def emitted_only_corrected(spark, sf_dir):
    found = _sequenced(spark, sf_dir)
    out = windows.corrected(found, _corrected(found), EVENT_TYPES).select("win_seq", F.lit(True).alias("emitted"))
    return found.select("win_seq").join(out, "win_seq", "left").select("win_seq", F.coalesce("emitted", F.lit(False)).alias("emitted"))


@query(
    f"""WITH w AS (SELECT {_M} AS minute, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT minute, sum(n) FILTER (event_type <> 'error') AS hits, coalesce(sum(n) FILTER (event_type = 'error'), 0) AS misses FROM w GROUP BY 1)
    SELECT minute, event_type, hits::bigint AS hits, misses::bigint AS misses, round((hits + misses)::double / hits * 1 * n / 34, 3) AS concentration FROM w JOIN t USING (minute) WHERE hits > 0"""
)
def corrected_concentration(spark, sf_dir):
    counts = windows.label_counts(table(spark, sf_dir, "events"), "event_type", "ts")
    bad = F.col("event_type") == "error"
    totals = counts.groupBy("minute").agg(F.coalesce(F.sum(F.when(~bad, F.col("n"))), F.lit(0)).alias("hits"), F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("misses")).filter("hits > 0")
    both = counts.join(totals, "minute")
    return both.select(_text("minute").alias("minute"), "event_type", "hits", "misses", scalars.concentration(F.col("hits"), F.col("misses"), F.lit(1), F.col("n")).alias("concentration"))


@query(
    f"""WITH {_WINDOWS}, r AS (SELECT strftime(m, '%Y-%m-%d %H:%M:%S') AS minute, win_seq, hits, misses, (click + error + purchase + signup + view)::bigint AS total, * EXCLUDE (m, h, win_seq, hits, misses)
        FROM w JOIN l USING (win_seq) WHERE win_seq <= (SELECT max(win_seq) FROM w) - 10)
    SELECT minute, to_json(struct_pack(win_seq := win_seq, minute := minute, hits := hits, misses := misses, "totalCount" := total,
        {", ".join(f'"uncorrected_{x}Count" := "{x}"' for x in EVENT_TYPES)},
        {", ".join(f'"{x}Count" := round((hits + misses)::double / hits * 1 * "{x}" / 34, 3)' for x in EVENT_TYPES)}))::varchar AS payload FROM r"""
)
def window_payload_json(spark, sf_dir):
    return windows.payloads(positional_correction(spark, sf_dir))


_EVENT_TIME = f"""{_WINDOWS},
    t AS (SELECT DISTINCT ctrl, m - INTERVAL 20 SECOND AS at FROM a JOIN w ON w.win_seq = a.ctrl),
    s AS (SELECT t.ctrl, t.at, w.m AS closes FROM t ASOF JOIN w ON date_trunc('minute', t.at) <= w.m),
    e AS (SELECT closes - (10 - n) * INTERVAL 1 MINUTE AS m, arg_max(hits, (s.at, n)) AS hits, arg_max(misses, (s.at, n)) AS misses FROM a JOIN s USING (ctrl) WHERE hits > 0 GROUP BY 1)"""


@query(
    f"""WITH {_EVENT_TIME} SELECT strftime(m, '%Y-%m-%d %H:%M:%S') AS minute, win_seq, hits, misses, (click + error + purchase + signup + view)::bigint AS "totalCount", {_OUT}
    FROM w JOIN e USING (m) WHERE win_seq <= (SELECT max(win_seq) FROM w) - 10"""
)
def event_time_correction(spark, sf_dir):
    """Control rows that arrive 20 seconds before a window, often in a gap, matched to minutes by time."""
    found = _sequenced(spark, sf_dir)
    places = found.select("win_seq", (F.col("minute").cast("timestamp") - F.expr("interval 20 seconds")).alias("arrival"))
    controls = _controls(found).join(places, "win_seq").drop("win_seq")
    seen = found.withColumn("minute", F.col("minute").cast("timestamp"))
    rows = windows.event_corrections(files.control_rows(controls), seen)
    return windows.corrected(seen, rows, EVENT_TYPES, by="minute").withColumn("minute", _text("minute"))


@query(
    f"""WITH w AS (SELECT date_trunc('minute', ts) AS m, count(*) AS n, arg_max(value, event_id) FILTER (event_type = 'purchase' AND value IS NOT NULL) AS v FROM events GROUP BY 1),
    c AS (SELECT unnest(generate_series(min(m), max(m), INTERVAL 1 MINUTE)) AS m FROM w)
    SELECT strftime(m, '%Y-%m-%d %H:%M:%S') AS minute, coalesce(n, 0) AS n, last_value(v IGNORE NULLS) OVER (ORDER BY m ROWS UNBOUNDED PRECEDING) AS last_purchase, n IS NULL AS idle FROM c LEFT JOIN w USING (m)"""
)
def dense_minutes(spark, sf_dir):
    """Every minute, those without arrivals too, with the last purchase known then."""
    rows = table(spark, sf_dir, "events").withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("value")))
    order = F.struct("ts", "event_id")
    found = rows.groupBy(windows.minute("ts").alias("minute")).agg(F.count("*").alias("n"), F.max_by("bought", F.when(F.col("bought").isNotNull(), order)).alias("last_purchase"))
    return windows.calendar(checkpoints.checkpointed(found), ["n"], ["last_purchase"]).withColumn("minute", _text("minute"))


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS stamp, strftime(date_trunc('minute', ts) + INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS boundary FROM events"""
)
def stamps_and_boundaries(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.iso_stamp(F.col("ts").cast("timestamp")).alias("stamp"), _text(scalars.next_boundary(F.col("ts"))).alias("boundary"))


# --- packets and names -------------------------------------------------------------------------------------------


def _as_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a file: part 0 names it, its turns are the parts after."""
    turns = table(spark, sf_dir, "conversations")
    fixed = [F.col("conv_id").cast("int").alias("field"), F.col("conv_id").cast("decimal(20,0)").alias("unique_id")]
    at = F.lit("2024-01-01 00:00:00").cast("timestamp").alias("arrival")
    total = turns.groupBy("conv_id").agg((F.max("turn") + 2).cast("int").alias("total_parts"))
    body = turns.join(total, "conv_id").select(*fixed, (F.col("turn") + 1).cast("int").alias("part"), "total_parts", F.lit(P.TAG_BODY).alias("tag"), F.coalesce("text", F.lit("")).cast("binary").alias("body"), at)
    name = F.concat(F.lit("D:\\images\\conv-"), F.col("conv_id").cast("string"), F.lit(".tif"))
    return body.unionByName(total.select(*fixed, F.lit(0).alias("part"), "total_parts", F.lit(P.TAG_NAME).alias("tag"), name.cast("binary").alias("body"), at))


_NAME = "regexp_replace(replace(url, '\\', '/'), '^.*/', '')"
#: Of the packets of the queries: bytes of a body at most, and what goes wrong with some.
_BODY = 300


def _datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A datagram for each turn, of its text's first bytes. Some of them end early, some say a part that is too high, some aren't there."""
    turns = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    body = F.substring(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 1, _BODY)
    part = F.when((conv + turn) % 11 == 3, turn + S.MOST_PARTS).otherwise(turn)
    whole = P.packed(conv % 2048, part, conv * 1_000_003 + 5_000_000_000, turn + 1, F.lit(P.TAG_BODY), body, conv * 7 + turn)
    sent = F.when((conv + turn) % 13 == 5, F.substring(whole, 1, 10)).when((conv + turn) % 17 == 6, F.substring(whole, F.lit(1), F.octet_length(whole) - 1)).when((conv + turn) % 19 != 7, whole)
    return checkpoints.checkpointed(turns.select(sent.alias("datagram"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("arrival")))  # as they land


_SENT = f"""s AS (SELECT conv_id AS c, turn AS t, encode(coalesce(text, ''))[1:{_BODY}] AS body, CASE WHEN (conv_id + turn) % 13 = 5 THEN '{P.SHORT}' WHEN (conv_id + turn) % 17 = 6 THEN '{P.TORN}' WHEN (conv_id + turn) % 19 = 7 THEN '{P.MISSING}'
        WHEN (conv_id + turn) % 11 = 3 OR turn >= {S.MOST_PARTS} THEN '{P.OUT_OF_RANGE}' END AS reason FROM conversations)"""


@query(
    f"""WITH {_SENT} SELECT (c * 7 + t)::bigint AS hash, (c % 2048)::int AS field, t::int AS part, (c * 1000003 + 5000000000)::bigint AS unique_id, (t + 1)::int AS total_parts, octet_length(body)::int AS data_size, 3 AS tag, md5(body) AS body
    FROM s WHERE reason IS NULL"""
)
def packet_headers(spark, sf_dir):
    """Headers and bodies of the datagrams that are taken."""
    taken = quarantine.accepted(P.judged(_datagrams(spark, sf_dir)))
    return P.decoded(taken).drop("arrival").withColumns({"unique_id": F.col("unique_id").cast("long"), "body": F.md5("body")})


@query(f"WITH {_SENT} SELECT reason, count(*) AS n FROM s WHERE reason IS NOT NULL GROUP BY 1")
def packet_quarantine(spark, sf_dir):
    return quarantine.reasons(P.judged(_datagrams(spark, sf_dir)))


_CONTROL_TEXT = "CASE WHEN turn % 2 = 0 THEN chr(10) ELSE '' END || conv_id || ',' || turn || CASE (conv_id + turn) % 9 WHEN 4 THEN ',1' WHEN 5 THEN 'x' ELSE '' END"


@query(
    f"""WITH x AS (SELECT conv_id, string_agg({_CONTROL_TEXT}, chr(10) ORDER BY turn) AS text, count(*) AS lines FROM conversations GROUP BY 1),
    y AS (SELECT conv_id, CASE WHEN lines != 6 THEN NULL ELSE i END AS n, CASE WHEN lines != 6 THEN text ELSE z[i] END AS line FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda l: trim(l) != '') AS z FROM x), range(1, 7) AS r(i) WHERE lines = 6 OR i = 1),
    v AS (SELECT *, CASE WHEN n IS NOT NULL THEN string_split(line, ',') END AS p FROM y),
    j AS (SELECT conv_id, n, CASE WHEN len(p) = 2 THEN try_cast(p[1] AS bigint) END AS hits, CASE WHEN len(p) = 2 THEN try_cast(p[2] AS bigint) END AS misses, len(p) AS width FROM v)
    SELECT conv_id, coalesce(n, 0)::int AS n, coalesce(hits, -1) AS hits, coalesce(misses, -1) AS misses,
        CASE WHEN n IS NULL THEN '{quarantine.LINES}' WHEN width != 2 THEN '{quarantine.WIDTH}' WHEN hits IS NULL OR misses IS NULL THEN '{quarantine.NUMBERS}' ELSE 'taken' END AS verdict FROM j"""
)
def control_quarantine(spark, sf_dir):
    """A text for each conversation, a line for each turn; those of six lines are whole, and some of their lines aren't two numbers."""
    conv, turn = F.col("conv_id"), F.col("turn")
    wrong = F.when((conv + turn) % 9 == 4, ",1").when((conv + turn) % 9 == 5, "x").otherwise("")
    line = F.concat(F.when(turn % 2 == 0, "\n").otherwise(""), conv.cast("string"), F.lit(","), turn.cast("string"), wrong)
    lines = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    texts = lines.select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))
    rows = quarantine.judged_controls(texts, exact=6)
    return rows.select("conv_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hits", F.lit(-1)).alias("hits"), F.coalesce("misses", F.lit(-1)).alias("misses"), F.coalesce("reason", F.lit("taken")).alias("verdict"))


@query(
    """SELECT p_partkey, least(p_size * 10, p_partkey % 301)::int AS low, greatest(p_size * 10, p_partkey % 301)::int AS high, trunc((p_size + p_partkey % 97) / 2)::int AS x, trunc((p_size * 3 + p_partkey % 89) / 2)::int AS y FROM part"""
)
def extents_and_midpoints(spark, sf_dir):
    """Ranges of two estimates, and the middle of two points that are read from their printed form."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("int")
    point = lambda x, y: F.concat(F.lit("array([["), x.cast("string"), F.lit(", "), y.cast("string"), F.lit("]], dtype=int32)"))
    printed = F.concat(F.lit("("), point(size, size * 3), F.lit(", "), point(key % 97, key % 89), F.lit(")"))
    rows = table(spark, sf_dir, "part").select("p_partkey", scalars.extent(size * 10, key % 301).alias("e"), scalars.midpoint(scalars.parse_points(printed)).alias("m"))
    return rows.select("p_partkey", "e.low", "e.high", F.get("m", 0).alias("x"), F.get("m", 1).alias("y"))


@query(f"""WITH u AS (SELECT {_NAME} || CASE page_id % 5 WHEN 0 THEN '.tif' WHEN 1 THEN '.JPG' WHEN 2 THEN '.png' WHEN 3 THEN '.jpeg' ELSE '' END AS name FROM pages) SELECT name, ends_with(name, '.tif') OR ends_with(name, '.png') OR ends_with(name, '.jpeg') OR ends_with(name, '.jpg') OR ends_with(name, '.tiff') AS image, contains(name, 'tif') AS tif, count(*) AS n FROM u GROUP BY ALL""")
def image_suffixes(spark, sf_dir):
    added = F.element_at(F.array(*map(F.lit, (".tif", ".JPG", ".png", ".jpeg", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    name = F.concat(scalars.basename(F.col("url")), added)
    rows = table(spark, sf_dir, "pages").select(name.alias("name"))
    return rows.groupBy("name", scalars.has_image_suffix(F.col("name")).alias("image"), files.is_tiff_name(F.col("name")).alias("tif")).agg(F.count("*").alias("n"))


@query("SELECT 'conv-' || conv_id || '.tif' AS filename, string_agg(coalesce(text, ''), '' ORDER BY turn) AS payload FROM conversations GROUP BY conv_id")
def reassemble_messages(spark, sf_dir):
    return reassembly.reassembled(_as_packets(spark, sf_dir)).select("filename", F.decode("payload", "UTF-8").alias("payload"))


@query("SELECT 'conv-' || conv_id || '.tif' AS filename, sum(octet_length(encode(coalesce(text, ''))))::bigint AS n_bytes FROM conversations GROUP BY conv_id HAVING count(*) FILTER ((conv_id + turn) % 7 = 0) = 0")
def complete_messages_only(spark, sf_dir):
    """With every packet lost whose conversation and turn add up to a multiple of seven."""
    left = _as_packets(spark, sf_dir).filter("part = 0 or (field + part - 1) % 7 != 0")
    return reassembly.reassembled(left).select("filename", F.octet_length("payload").cast("long").alias("n_bytes"))


@query(
    f"""WITH u AS (SELECT {_NAME} AS name FROM pages)
    SELECT CASE WHEN ends_with(name, '.tif') AND lower(name) <> 'background.tif' THEN 'image' WHEN name = 'HitsMisses.txt' THEN 'control' ELSE 'other' END AS route,
    regexp_extract(name, '(\\.[^.]*)$', 1) AS extension, count(*) AS n FROM u GROUP BY 1, 2"""
)
def route_by_name(spark, sf_dir):
    name = scalars.basename(F.col("url"))
    return table(spark, sf_dir, "pages").groupBy(scalars.route(name).alias("route"), scalars.extension(name).alias("extension")).agg(F.count("*").alias("n"))


@query(
    """WITH RECURSIVE l AS (SELECT p_name, row_number() OVER (ORDER BY p_name) AS i FROM (SELECT DISTINCT p_name FROM part)),
    r AS (SELECT 0::bigint AS i, []::varchar[] AS keys UNION ALL  -- label after label, each beside the keys before it
        SELECT l.i, list_append(keys, CASE WHEN NOT list_contains(keys, left(p_name, 5)) THEN left(p_name, 5)
            ELSE left(p_name, 4) || list_min(list_filter(range(1, l.i + 1), lambda n: NOT list_contains(keys, left(p_name, 4) || n))) END) FROM r JOIN l ON l.i = r.i + 1)
    SELECT p_name, keys[l.i] AS key FROM l, (SELECT keys FROM r ORDER BY i DESC LIMIT 1)"""
)
def unique_labels(spark, sf_dir):
    return labels.unique_key_column(table(spark, sf_dir, "part").select("p_name").distinct(), "p_name", 5)


@query("SELECT p_partkey, CASE WHEN starts_with(p_name, 'a') THEN 'A' WHEN starts_with(p_name, 'b') THEN 'B' ELSE 'rest' END AS label_group FROM part")
def label_groups(spark, sf_dir):
    patterns = spark.createDataFrame([(i, *p) for i, p in enumerate(PATTERNS)], "rank int, pattern string, label_group string")
    return joins.label_groups(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", patterns).select("p_partkey", "label_group")


# --- measurements --------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, round(2 * sqrt(p_size::double * 100 / pi()), 6) AS diameter FROM part")
def equivalent_diameter(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(scalars.equivalent_diameter(F.col("p_size")), 6).alias("diameter"))


@query("SELECT s_suppkey, round((s_suppkey % 90 + (s_suppkey % 60)::double / 60 + (s_suppkey * 7 % 60)::double / 3600) * CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE 1 END + 0.0::double, 9) AS latitude FROM supplier")
def dms_to_decimal(spark, sf_dir):
    k = F.col("s_suppkey")
    degrees = scalars.dms_to_degrees(k % 90, k % 60, k * 7 % 60, F.when(k % 2 == 0, "S").otherwise("N"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(degrees, 9).alias("latitude"))


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::int AS class FROM embeddings")
def argmax_class(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", scalars.argmax(F.col("embedding")).alias("class"))


_CLASS = "(list_position(embedding, list_max(embedding)) - 1)::int % 8"


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label") % 8, (scalars.argmax(F.col("embedding")) % 8).alias("found")).toDF("label", "found")


@query(f"SELECT label % 8 AS actual, {_CLASS} AS predicted, count(*) AS n FROM embeddings GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return joins.confusion(_classed(spark, sf_dir), "label", "found")


@query(f"SELECT count(*) AS n, round(count(*) FILTER (label % 8 = {_CLASS})::double / count(*), 9) AS accuracy FROM embeddings WHERE label IS NOT NULL")
def accuracy(spark, sf_dir):
    return joins.accuracy(_classed(spark, sf_dir), "label", "found").withColumn("accuracy", F.round("accuracy", 9))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::double - list_max(embedding)::double)) AS p FROM embeddings)
    SELECT vec_id, round(list_max(p) / list_sum(p), 6) AS top_score FROM e"""
)
def softmax_scores(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.array_max(scalars.softmax(F.col("embedding"))), 6).alias("top_score"))


@query("SELECT vec_id, round(embedding[1]::double * 0.2125::double + embedding[2]::double * 0.7154::double + embedding[3]::double * 0.0721::double, 6) AS gray FROM embeddings")
def gray_weight(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(scalars.gray(F.col("embedding")), 6).alias("gray"))


@query(
    """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: floor(abs(x::double) * 1000) % 256) AS v FROM embeddings)
    SELECT vec_id, list_sum(list_transform(list_zip(v, list_reverse(v)), lambda z: greatest(0.0::double, least(255.0::double, z[1] - (255.0::double - z[2])))))::bigint AS total FROM p"""
)
def background_subtract(spark, sf_dir):
    """Pixels made of embeddings, their reverse as the background."""
    rows = table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("double") % 256))
    left = scalars.less_background(F.col("v"), F.reverse("v"))
    return rows.select("vec_id", F.aggregate(left, F.lit(0.0), lambda a, x: a + x).cast("long").alias("total"))


@query(
    """WITH p AS (SELECT label, embedding[1]::double AS x, embedding[2]::double AS y FROM embeddings)
    SELECT a.label, (SELECT count(*) FROM p c WHERE c.label = a.label) AS n_points, round(max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 9) AS max_distance FROM p a JOIN p b ON a.label = b.label GROUP BY a.label"""
)
def max_pair_distance(spark, sf_dir):
    found = joins.widest_pairs(table(spark, sf_dir, "embeddings"), "label", F.get("embedding", 0), F.get("embedding", 1))
    return found.withColumn("max_distance", F.round("max_distance", 9))


#: Discs that are passed on together: as files they are large beside the rows that they are drawn from.
DISCS = 64


@F.pandas_udf(T.BinaryType())
def _disc(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A dark disc on white, and a row of white background after the file."""
    y, x = np.mgrid[:128, :128]
    away = np.stack([(x - 64) ** 2 + (y - 64) ** 2] * 3, axis=2).astype(np.int16)

    def one(r, t):
        pixels = np.full((128, 128, 3), 255, np.uint8)
        pixels[away <= r * r] = t
        return tiff.encode(pixels, "2024:01:01 00:00:00", ((50, 30, 0), "N", (4, 15, 36), "W")) + b"\xff" * 384

    for radius, tone in columns:
        for first in range(0, len(radius), DISCS):
            some = slice(first, first + DISCS)
            yield pd.Series([one(r, t) for r, t in zip(radius.iloc[some], tone.iloc[some].to_numpy().astype(np.uint8), strict=True)])


@query()
def image_measures(spark, sf_dir):
    """Discs drawn with the radius of each part's size: background corrected, measured, placed and classified."""
    few = table(spark, sf_dir, "part").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")  # small rows, much work on each: no core waits long for another
    rows = few.select("p_partkey", images.viewer()(_disc(F.col("p_size"), F.col("p_partkey") % 200)).alias("s"))
    return rows.select("p_partkey", *(F.round(f"s.{c}", 6).alias(c) for c in ("esd_1", "esd_2", "object_length")), F.round("s.latitude", 9).alias("latitude"), F.col("s.label").alias("label"))


# --- sources and sinks, there and back -----------------------------------------------------------------------------


def _fresh(spark: SparkSession) -> str:
    """A folder of this run's own, where driver and executors reach it."""
    return f"{checkpoints.folder(spark)}/flow-{uuid.uuid4().hex}"


#: When a turn of the queries arrives: conversations follow each other by seven minutes, turns by one.
_ARRIVAL = "(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * (conv_id * 7 + turn))"


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as an image file: its text is what the file holds."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("conv_id") * 7 + F.col("turn")) * 60)
    end = F.element_at(F.array(*map(F.lit, (".tif", ".JPG", ".png", ".txt", ".tiff"))), (F.col("turn") % 5 + 1).cast("int"))
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), end)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", name.alias("filename"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"), at.alias("arrival"))


_FILENAME = "'c' || conv_id || '-' || turn || ['.tif', '.JPG', '.png', '.txt', '.tiff'][(turn % 5 + 1)::int]"


@query(
    f"""SELECT strftime({_ARRIVAL}, 'pi-%Y-%m-%d-%H-') || (minute({_ARRIVAL}) // 10) || '0' AS bin, {_FILENAME} AS filename, octet_length(encode(coalesce(text, '')))::bigint AS n_bytes, md5(coalesce(text, '')) AS digest FROM conversations"""
)
def bins_there_and_back(spark, sf_dir):
    """Images written to ten-minute containers, and read from them in ranges of records."""
    path = _fresh(spark)
    bins.write(_pictures(spark, sf_dir), path)
    found = bins.read(spark, path, most=1 << 14)
    return found.select(F.regexp_extract("bin", r"(pi-\d{4}-\d\d-\d\d-\d\d-\d0)[^/]*$", 1).alias("bin"), "filename", F.octet_length("payload").cast("long").alias("n_bytes"), F.md5("payload").alias("digest"))


@query(
    f"""WITH f AS (SELECT {_FILENAME} AS filename, md5(coalesce(text, '')) AS digest, CASE WHEN turn % 2 = 0 THEN 'even-' ELSE '' END AS label FROM conversations)
    SELECT label || filename AS filename, digest, contains(filename, 'tif') AS tif FROM f WHERE regexp_matches(filename, '\\.(jpg|jpeg|tif|tiff|png)$')"""
)
def folders_there_and_back(spark, sf_dir):
    """Images written to a file each, some with a label before their names, and the folder read again: as images, and as those called tif."""
    path = _fresh(spark)
    files.write_images(_pictures(spark, sf_dir), path, prefix=F.when(F.col("turn") % 2 == 0, "even"))
    seen = files.images(spark, path).select("filename", F.md5("payload").alias("digest"))
    return seen.join(files.tiffs(spark, path).select("filename", F.lit(True).alias("tif")), "filename", "left").withColumn("tif", F.coalesce("tif", F.lit(False)))


@query(
    """SELECT p_partkey || '.tif' AS filename, p_size::double AS esd_1, p_size::double / 4 AS esd_2, CASE WHEN p_partkey % 3 != 0 THEN (p_partkey % 100)::double END AS threshold_area, CASE WHEN p_partkey % 3 != 0 AND p_partkey % 5 != 1 THEN ((p_partkey % 97) * 10 + p_size)::bigint ELSE -1 END AS points,
    CASE WHEN p_partkey % 5 = 1 AND p_partkey % 3 != 0 THEN 'points do not parse' ELSE 'taken' END AS verdict FROM part"""
)
def measures_there_and_back(spark, sf_dir):
    """A headerless table of measurements, written and read: some parts measure nothing and have no points, of others the points are cut short and are told."""
    path, key, size = _fresh(spark), F.col("p_partkey"), F.col("p_size")
    measured = key % 3 != 0
    points = F.to_json(F.array(F.array((key % 97).cast("int"), size.cast("int")), F.array(size.cast("int"), (key % 97).cast("int"))))
    nothing = F.lit(None).cast("double")
    files.write_table(
        table(spark, sf_dir, "part").select(
            F.concat(key.cast("string"), F.lit(".tif")).alias("filename"), size.cast("double").alias("esd_1"), (size.cast("double") / 4).alias("esd_2"), F.when(measured, (key % 100).cast("double")).alias("threshold_area"), nothing.alias("otsu"), nothing.alias("length"),
            F.when(measured & (key % 5 == 1), F.substring(points, 1, 5)).when(measured, points).alias("points"),
        ), path, header=False,
    )
    rows = quarantine.judged_measures(spark, path)
    x = lambda i, j: F.get(F.get("max_points", i), j)
    held = F.when(F.col("reason").isNull() & F.col("max_points").isNotNull(), (x(0, 0) * 10 + x(1, 0)).cast("long"))
    return rows.select("filename", "esd_1", "esd_2", "threshold_area", F.coalesce(held, F.lit(-1).cast("long")).alias("points"), F.coalesce("reason", F.lit("taken")).alias("verdict"))


# --- streams that are stopped and taken up again ---------------------------------------------------------------------


def _resumed(landings: list[DataFrame], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a streaming operator adds to its table as landings come in one after the other, each taken by a query that resumes the one before."""
    spark = landings[0].sparkSession
    path = _fresh(spark)
    for rows in landings:
        rows.write.mode("append").parquet(f"{path}/landed")
        stream = operator(spark.readStream.schema(rows.schema).parquet(f"{path}/landed"))
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("SELECT 'conv-' || conv_id || '.tif' AS filename, md5(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS payload FROM conversations GROUP BY conv_id HAVING count(*) FILTER ((conv_id + turn) % 7 = 0) = 0")
def resumed_files(spark, sf_dir):
    """Files put together from datagrams of a stream that stops between their parts; those that lose a packet never come out."""
    sent = _as_packets(spark, sf_dir).filter("part = 0 or (field + part - 1) % 7 != 0")
    number = lambda c: F.col(c).cast("long")
    whole = P.packed(number("field") % 65536, number("part"), number("unique_id"), number("total_parts"), number("tag"), F.col("body"))
    landed = checkpoints.checkpointed(sent.select("part", whole.alias("datagram"), "arrival"))
    halves = [landed.filter(F.col("part") % 2 == k).select("datagram", "arrival") for k in (1, 0)]
    return _resumed(halves, lambda rows: stream_files.reassembled(P.decoded(rows))).select("filename", F.md5("payload").alias("payload"))


@query("SELECT event_id, rn FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn % 10 = 0")
def resumed_sample(spark, sf_dir):
    """Every tenth event of each type, counted on across a restart."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    ends = rows.agg(F.min("ts"), F.max("ts")).first()
    cut = F.lit(ends[0] + (ends[1] - ends[0]) / 2) if ends[0] else F.lit(None).cast("timestamp")
    early = F.coalesce(F.col("ts") < cut, F.lit(True))
    return _resumed([rows.filter(early), rows.filter(~early)], lambda s: sampling.every_nth(s, 10, ("ts", "event_id"), "event_type")).select("event_id", "rn")


@query(
    f"""SELECT filename, strftime(m, '%Y-%m-%d %H:%M:%S') AS minute, (row_number() OVER (PARTITION BY m ORDER BY arrival, filename) - 1) // 3 AS batch
    FROM (SELECT {_FILENAME} AS filename, {_ARRIVAL} AS arrival, date_trunc('minute', {_ARRIVAL}) AS m FROM conversations)"""
)
def resumed_batches(spark, sf_dir):
    """Images in batches of three at most, released when full or when their minute closes, before or after a restart; a late arrival closes the last."""
    rows = checkpoints.checkpointed(_pictures(spark, sf_dir).select("filename", "arrival"))
    ends = rows.agg(F.min("arrival"), F.max("arrival")).first()
    cut = F.lit(ends[0] + (ends[1] - ends[0]) / 2) if ends[0] else F.lit(None).cast("timestamp")
    after = rows.agg((F.max("arrival") + F.expr("INTERVAL 1 HOUR")).alias("arrival")).select(F.lit("end").alias("filename"), "arrival")
    found = _resumed([rows.filter(F.col("arrival") < cut), rows.filter(F.col("arrival") >= cut), after], lambda s: sampling.batched(s, 3))
    return found.select("filename", _text("minute").alias("minute"), "batch")
