"""Streaming operators whose state outlives batches and restarts, each beside its batch form."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.test_streams import LABELS, START, as_files, controls, datagrams, events
from tidestream import schemas as S
from tidestream.operators import reassembly, windows
from tidestream.sources import files, packets
from tidestream.streaming import reassembly as stream_files
from tidestream.streaming import sampling, state
from tidestream.streaming import windows as stream_windows

END = dt.timedelta(hours=2)


def ran(stream, spark, folder, name):
    """The rows that a query has added when it has taken all input; each call is a restart from its checkpoint."""
    path = f"{folder}/{name}"
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return spark.read.parquet(path), query


def test_files_of_a_stream_with_restarts_are_those_of_the_batch_form(spark, tmp_path):
    rnd = random.Random(7)
    sent = {f"f{i}.tif": rnd.randbytes(rnd.randint(1, 6000)) for i in range(25)}
    rows = [x for i, (n, p) in enumerate(sent.items()) for x in datagrams(n, p, i % 4, 2**63 + i, START)]
    rnd.shuffle(rows)
    rows = [(d, START + dt.timedelta(seconds=0.05 * k)) for k, (d, _) in enumerate(rows + rows[::4])]
    rows += [(d, START) for d, _ in datagrams("lost.tif", b"z" * 3000, 9, 7, START)[:-1]] + [(packets.encoded(9, 1, 8, 0, 3, b"q"), START), (packets.encoded(9, 1024, 7, 5, 3, b"q"), START), (b"short", START)]
    third = len(rows) // 3 + 1
    for k in range(3):  # a restart mid-file, twice
        as_files(spark, rows[k * third : (k + 1) * third], str(tmp_path / "landed"))
        stream = stream_files.reassembled(packets.decoded(packets.landed_stream(spark, str(tmp_path / "landed"))))
        found, query = ran(stream, spark, tmp_path, "files")
        held = state.table(spark, f"{tmp_path}/files-checkpoint", "parts")
        if k < 2:
            assert held.count() > 0
    got = [(r.filename, bytes(r.payload)) for r in found.collect()]
    assert sorted(got) == sorted(sent.items())
    batch = reassembly.reassembled(packets.decoded(packets.landed(spark, str(tmp_path / "landed"))))
    assert sorted(got) == sorted((r.filename, bytes(r.payload)) for r in batch.collect())
    assert {r.key.unique_id for r in held.select("key").collect()} == {"7", "8"}  # of what is complete no body is held


def test_a_batch_writes_the_parts_that_came_with_it(spark, tmp_path):
    parts = datagrams("big.tif", bytes(700) * 60, 1, 5, START)
    written = []
    for k in range(3):
        as_files(spark, parts[k * 20 : (k + 1) * 20], str(tmp_path / "landed"))
        _, query = ran(stream_files.reassembled(packets.decoded(packets.landed_stream(spark, str(tmp_path / "landed")))), spark, tmp_path, "files")
        ops = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
        written.append(sum(ops))
    assert max(written) <= 20 + 4  # parts, and the head with its timer; never those of the batches before


def test_a_file_is_forgotten_when_nothing_comes(spark, tmp_path):
    whole, late = datagrams("a.tif", b"x" * 900, 1, 1, START), datagrams("b.tif", b"y" * 900, 2, 2, START)
    after = [(d, START + END) for d, _ in datagrams("c.tif", b"z", 3, 3, START)]
    for rows in (whole[:1] + late[:2], after, [(d, START + END) for d, _ in late[2:] + whole]):
        as_files(spark, rows, str(tmp_path / "landed"))
        found, _ = ran(stream_files.reassembled(packets.decoded(packets.landed_stream(spark, str(tmp_path / "landed")))), spark, tmp_path, "files")
    assert sorted(r.filename for r in found.collect()) == ["a.tif", "c.tif"]  # a came again whole; of b the first parts were given up


def arrivals(n, seed=1):
    rnd = random.Random(seed)
    at = sorted(rnd.randrange(0, 40 * 60) for _ in range(n))  # many of one second
    return [(f"i{k:04d}", b"%d" % k, START + dt.timedelta(seconds=s), k % 2) for k, s in enumerate(at)]


IMAGES = "filename string, payload binary, arrival timestamp, camera int"


def test_every_nth_of_a_stream_is_that_of_the_batch_form_across_restarts(spark, tmp_path):
    rows = arrivals(300)
    order = ["arrival", "filename"]
    edges = [0, 90, 91, 300]  # between batches that the order of arrival doesn't part
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        spark.createDataFrame(rows[a:b], IMAGES).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(IMAGES).parquet(str(tmp_path / "in"))
        one, _ = ran(sampling.every_nth(stream, 7, order), spark, tmp_path, "one")
        by, _ = ran(sampling.every_nth(stream, 7, order, "camera"), spark, tmp_path, "by")
    want = reassembly.every_nth(spark.createDataFrame(rows, IMAGES), 7, order, windows.minute())
    assert sorted((r.rn, r.filename) for r in one.collect()) == sorted((r.rn, r.filename) for r in want.collect())
    for camera in (0, 1):
        own = [r[0] for r in rows if r[3] == camera]
        assert sorted(r.filename for r in by.filter(F.col("camera") == camera).collect()) == own[6::7]
    assert state.table(spark, f"{tmp_path}/one-checkpoint", "count").select("value.n").collect()[0][0] == 300


def test_batches_are_released_when_full_or_when_their_minute_closes(spark, tmp_path):
    def named(rows):
        return pd.DataFrame({"filename": rows["filename"], "size": [len(rows)] * len(rows)})

    rows = [r for r in arrivals(500, 3) if not 600 < (r[2] - START).seconds < 900]
    schema = T.StructType([T.StructField("filename", T.StringType()), T.StructField("size", T.LongType())])
    size = 5
    for k in range(3):
        part = rows[k * 150 : (k + 1) * 150] if k < 2 else rows[300:]
        spark.createDataFrame(part, IMAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(IMAGES).parquet(str(tmp_path / "in"))
        found, _ = ran(sampling.batched(stream, size, "0 seconds", function=named, schema=schema), spark, tmp_path, "batches")
    got = found.toPandas()
    assert got["filename"].is_unique
    last = max(r[2] for r in rows).replace(second=0)
    by_minute = {}
    for r in rows:
        by_minute.setdefault(r[2].replace(second=0), []).append(r[0])
    closed = {m: names for m, names in by_minute.items() if m < last}
    for minute, names in by_minute.items():
        own = got[got["minute"] == pd.Timestamp(minute)]
        if minute in closed:
            assert sorted(own["filename"]) == names  # none is held past its window
        sizes = own.groupby("batch")["size"].agg(["first", "count"])
        assert (sizes["first"] == sizes["count"]).all() and (sizes["first"].iloc[:-1] == size).all() and (sizes["first"] <= size).all()
    held = {r[0] for r in rows} - set(got["filename"])
    assert len(held) < size and held <= set(by_minute[last])
    assert state.table(spark, f"{tmp_path}/batches-checkpoint", "held").count() == len(held)


def test_an_hours_minutes_are_kept_together_and_batched_by_themselves(spark, tmp_path):
    rows = [(f"i{m:02d}-{k}", b"", START + dt.timedelta(minutes=m, seconds=k), 0) for m in range(60) for k in range(m % 5)]
    for part in (rows[::2], rows[1::2], [("end", b"", START + dt.timedelta(days=1), 0)]):
        spark.createDataFrame(part, IMAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(IMAGES).parquet(str(tmp_path / "in"))
        found, _ = ran(sampling.batched(stream, 3, "2 hours"), spark, tmp_path, "hours")
        assert state.table(spark, f"{tmp_path}/hours-checkpoint", "counts").count() <= 2
    got = {r.filename: (r.minute, r.batch) for r in found.collect()}
    assert len(got) == len(rows) and {f: m for f, (m, _) in got.items()} == {r[0]: r[2].replace(second=0) for r in rows}
    for m in range(60):
        sizes = pd.Series([got[r[0]][1] for r in rows if r[0].startswith(f"i{m:02d}-")], dtype=int).value_counts().sort_index()
        assert sizes.tolist() == [x for x in (min(3, m % 5), m % 5 - 3) if x > 0] and sizes.index.tolist() == list(range(len(sizes)))


def test_a_delay_line_that_is_stopped_and_resumed_emits_what_an_unbroken_one_does(spark, tmp_path):
    rows = spark.createDataFrame(events(), "arrival timestamp, label string, value double")
    closed = windows.wide_counts(rows, LABELS).orderBy("minute").collect()
    control = spark.createDataFrame(controls(), "arrival timestamp, text string")
    parsed = files.control_rows(control).groupBy("arrival").agg(F.array_sort(F.collect_list(F.struct("n", "hits", "misses"))).alias("rows")).orderBy("arrival").collect()
    schema, control_schema = T.StructType([T.StructField("minute", T.TimestampType()), *(T.StructField(x, T.LongType()) for x in LABELS)]), T.StructType([T.StructField("arrival", T.TimestampType()), T.StructField("rows", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "hits", "misses")])))])

    def emitted(folder, cuts):
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = closed[a:b]
            until = part[-1].minute + dt.timedelta(minutes=1)
            since = part[0].minute if a else START - END
            spark.createDataFrame([tuple(r) for r in part], schema).coalesce(1).write.mode("append").parquet(f"{folder}/closed")
            own = [(r.arrival, [tuple(x) for x in r.rows]) for r in parsed if since <= r.arrival < until or (b == len(closed) and r.arrival >= until)]
            spark.createDataFrame(own, control_schema).coalesce(1).write.mode("append").parquet(f"{folder}/controls")
            line = stream_windows.emitted(spark.readStream.schema(schema).parquet(f"{folder}/closed"), spark.readStream.schema(control_schema).parquet(f"{folder}/controls"), LABELS)
            out, _ = ran(line, spark, folder, "out")
        return sorted((r.minute, r.record) for r in out.collect())

    unbroken, broken = tmp_path / "a", tmp_path / "b"
    want = emitted(unbroken, [0, len(closed)])
    assert len(want) > 10 and emitted(broken, [0, 7, 15, 16, len(closed)]) == want
    for folder in (unbroken, broken):
        (line,) = state.table(spark, f"{folder}/out-checkpoint").select("value.*").collect()
        assert len(line[0]["line"]) == windows.DELAY + 1 if "groupState" in line.asDict() else len(line.line) == windows.DELAY + 1
    assert state.operators(spark, f"{broken}/out-checkpoint").count() == 1
