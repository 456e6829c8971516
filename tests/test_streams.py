import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidestream import schemas as S
from tidestream.functions import tiff
from tidestream.operators import reassembly, windows
from tidestream.plans import imaging
from tidestream.sources import files, packets
from tidestream.streaming import publish
from tidestream.streaming import reassembly as stream_files
from tidestream.streaming import windows as stream_windows
from tests.test_images import PLACE, disc

START = dt.datetime(2024, 1, 1)
LABELS = ("a", "b")


def datagrams(name, payload, field, unique_id, at, size=700):
    bodies = [payload[i : i + size] for i in range(0, len(payload), size)]
    total = len(bodies) + 1
    out = [packets.encoded(field, 0, unique_id, total, packets.TAG_NAME, f"D:\\x\\{name}".encode())]
    out += [packets.encoded(field, k, unique_id, total, packets.TAG_BODY, b) for k, b in enumerate(bodies, 1)]
    return [(d, at) for d in out]


def as_files(spark, rows, path, parts=1):
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], S.DATAGRAM).coalesce(1).write.mode("append").parquet(path)


def test_reassembly_whatever_the_order(spark, tmp_path):
    rnd = random.Random(1)
    sent = {f"f{i}.tif": rnd.randbytes(rnd.randint(1, 4000)) for i in range(12)}
    rows = [x for i, (n, p) in enumerate(sent.items()) for x in datagrams(n, p, i % 5, 2**40 + i, START)]
    lost = datagrams("lost.tif", b"z" * 3000, 9, 7, START)[:-1] + [(packets.encoded(9, 1024, 7, 5, 3, b"q"), START), (b"short", START)]
    rows += rows[::3] + lost
    rnd.shuffle(rows)
    decoded = packets.decoded(spark.createDataFrame(rows, S.DATAGRAM))
    got = {r.filename: bytes(r.payload) for r in reassembly.reassembled(decoded).collect()}
    assert got == sent
    assert reassembly.rejected(decoded).count() == 1 and packets.malformed(spark.createDataFrame(rows, S.DATAGRAM)).count() == 1
    assert decoded.filter("field = 0").select("unique_id").distinct().count() == 3

    rows = [(d, START + dt.timedelta(seconds=i)) for i, (d, _) in enumerate(x for n, p in sent.items() for x in datagrams(n, p, hash(n) % 3, 100 + int(n[1:-4]), START))]
    as_files(spark, rows, str(tmp_path / "landed"))
    stream = stream_files.reassembled(packets.decoded(packets.landed_stream(spark, str(tmp_path / "landed"))))
    q = stream.writeStream.format("memory").queryName("whole_files").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.filename: bytes(r.payload) for r in spark.table("whole_files").collect()} == sent


def events(n=400, minutes=40, seed=3):
    rnd = random.Random(seed)
    at = sorted(rnd.uniform(0, minutes * 60) for _ in range(n))
    return [(START + dt.timedelta(seconds=s), rnd.choice(LABELS), rnd.random()) for s in at if not 600 < s < 800]


def controls():
    out = []
    for m in range(2, 39, 3):
        lines = [f"{(m * n) % 7},{n}" for n in range(1, 11)]
        out.append((START + dt.timedelta(minutes=m, seconds=30), "\n".join(lines)))
    return [*out, (START + dt.timedelta(minutes=20), "1,1\n2,2")]


def test_stream_gives_what_batch_gives(spark, tmp_path):
    rows = spark.createDataFrame(events(), "arrival timestamp, label string, value double")
    control = spark.createDataFrame(controls(), "arrival timestamp, text string")
    closed = windows.sequenced(windows.wide_counts(rows, LABELS))
    last_open = closed.agg(F.max("minute")).first()[0]
    closed_only = closed.filter(F.col("minute") < F.lit(last_open))
    found = windows.corrections(files.control_rows(windows.control_sequence(control, closed_only)))
    want = {r.minute: r.asDict() for r in windows.corrected(closed_only, found, LABELS).collect()}
    assert len(want) > 10

    rows.coalesce(1).write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows"))
    q = stream_windows.closed_windows(stream, LABELS).writeStream.format("parquet").option("path", str(tmp_path / "closed")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    done = spark.read.parquet(str(tmp_path / "closed"))
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, closed_only.drop("win_seq").collect()))
    parsed = files.control_rows(control).groupBy("arrival").agg(F.array_sort(F.collect_list(F.struct("n", "hits", "misses"))).alias("rows"))
    parsed.coalesce(1).write.parquet(str(tmp_path / "controls"))
    done_stream = spark.readStream.schema(done.schema).parquet(str(tmp_path / "closed"))
    control_stream = spark.readStream.schema(parsed.schema).parquet(str(tmp_path / "controls"))
    emitted = stream_windows.emitted(done_stream, control_stream, LABELS)
    q = emitted.writeStream.format("memory").queryName("emitted").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.minute: json.loads(r.record) for r in spark.table("emitted").collect()}
    assert set(got) == set(want)
    for k, record in got.items():
        assert record == {c: pytest.approx(v, abs=0.0011) for c, v in want[k].items() if c not in ("minute", "win_seq")}


def test_unsent_messages_are_sent_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(publish, "PAUSE", 0.0)
    spark.range(6).select(F.col("id").alias("k"), F.format_string('{"k":%d}', "id").alias("payload")).write.parquet(str(tmp_path / "in"))
    take, marker = publish.JsonFiles(str(tmp_path / "queue")), str(tmp_path / "up")

    def transport(key, message):  # odd keys are refused until the marker is there
        return (int(key) % 2 == 0 or os.path.exists(marker)) and take(key, message)

    stream = spark.readStream.schema("k long, payload string").parquet(str(tmp_path / "in"))
    publish.published(stream, "k", str(tmp_path / "box"), transport, str(tmp_path / "c"), availableNow=True).awaitTermination(120)
    assert sorted(p.name for p in (tmp_path / "queue").iterdir()) == ["0.json", "2.json", "4.json"]
    (tmp_path / "up").touch()
    publish.send_pending(spark, str(tmp_path / "box"), transport, "later")
    assert len(list((tmp_path / "queue").iterdir())) == 6
    assert spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "box" / "sent")).count() == 6


def test_packets_to_records(spark, tmp_path):
    rows, n = [], 0
    for minute in range(14):
        for k in range(2):
            at = START + dt.timedelta(minutes=minute, seconds=10 + k)
            image = tiff.encode(disc(10 + minute), "2024:01:01 00:00:00", PLACE) + b"\xff" * 360
            rows += datagrams(f"i{n}.tif", image, n % 50, 1000 + n, at, size=8000)
            n += 1
    rows += datagrams("background.tif", b"x", 60, 1, START) + datagrams("HitsMisses.txt", "\n".join(f"{i},{i}" for i in range(1, 11)).encode(), 61, 2, START + dt.timedelta(minutes=10))
    as_files(spark, rows, str(tmp_path / "landed"))
    records = imaging.from_packets(spark, str(tmp_path / "landed"), imaging.Settings(survey="s", every=1)).collect()
    assert [r.time_start.minute for r in sorted(records, key=lambda r: r.time_start)] == [1, 2, 3]
    for r in records:
        assert r.totalCount == 2 and r.latitude == -50.5 and r.survey == "s"
        assert r.equispherdiameter_otsu == pytest.approx(20 * (10 + r.time_start.minute), rel=0.06)
        assert sum(r[f"{x}Count"] for x in imaging.LABEL_KEYS) == pytest.approx(round(2 * 2 / 34, 3), abs=0.002)
