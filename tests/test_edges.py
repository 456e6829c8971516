import datetime as dt
import logging
import math
import socket
import threading
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.test_images import PLACE, disc
from tests.test_streams import START, as_files, datagrams
from tidestream import schemas as S
from tidestream.functions import images, scalars, shapes, tiff
from tidestream.operators import joins, reassembly
from tidestream.plans import imaging
from tidestream.sources import bins, collector, files, packets
from tidestream.streaming import monitor, publish
from tidestream.streaming import reassembly as stream_files


def test_a_task_that_fails_and_runs_again_leaves_each_record_once(spark, tmp_path):
    rows = [{"filename": f"i{k}", "payload": bytes([k]), "bin": f"pi-{k // 2}0.bin"} for k in range(4)]

    def torn():
        yield from rows[:3]
        raise OSError("lost")

    writer = bins._BinWriter(str(tmp_path / "b"))
    with pytest.raises(OSError, match="lost"):
        writer.write(torn())
    other = writer.write(iter(rows))  # a try whose commit is not taken
    taken = writer.write(iter(rows))
    assert other.files != taken.files and bins.read(spark, str(tmp_path / "b")).count() == 0
    writer.commit([taken, None])
    assert sorted(r.filename for r in bins.read(spark, str(tmp_path / "b")).collect()) == ["i0", "i1", "i2", "i3"]
    assert sorted(p.name[:5] for p in (tmp_path / "b").iterdir()) == ["pi-00", "pi-10"]
    again = bins._BinWriter(str(tmp_path / "b"))
    again.abort([again.write(iter(rows))])
    assert bins.read(spark, str(tmp_path / "b")).count() == 4


def test_datagrams_shorter_than_they_say_are_malformed(spark):
    whole = packets.encoded(1, 0, 1, 1, packets.TAG_BODY, b"12345678")
    rows = [(whole, START), (whole[:27], START), (whole[:24], START), (whole[:5], START), (b"", START), (None, START), (whole + b"more", START), (packets.encoded(1, 0, 1, 1, 1, b""), START)]
    df = spark.createDataFrame(rows, S.DATAGRAM)
    assert sorted(bytes(r.body) for r in packets.decoded(df).collect()) == [b"", b"12345678", b"12345678"]
    assert packets.malformed(df).count() == 5


def test_parts_beyond_the_total_do_not_complete_a_file(spark, tmp_path):
    def sent(field, parts):
        return [(packets.encoded(field, k, 50 + field, 3, packets.TAG_BODY if k else packets.TAG_NAME, b"d.tif" if not k else bytes([k])), START + dt.timedelta(seconds=k)) for k in parts]

    rows = sent(1, [0, 1, 3]) + sent(2, [0, 1, 2, 3, 7]) + sent(3, [1, 2, 1])
    got = reassembly.reassembled(packets.decoded(spark.createDataFrame(rows, S.DATAGRAM))).collect()
    assert [bytes(r.payload) for r in got] == [b"\x01\x02"]
    as_files(spark, rows, str(tmp_path / "landed"))
    stream = stream_files.reassembled(packets.decoded(packets.landed_stream(spark, str(tmp_path / "landed"))))
    stream.writeStream.format("memory").queryName("stray").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert [bytes(r.payload) for r in spark.table("stray").collect()] == [b"\x01\x02"]


def test_measures_read_what_write_table_wrote(spark, tmp_path):
    rows = [("a.tif", 1.0, 2.0, 3.0, 4.0, 5.0, [[62, 54], [78, 66]]), ("b.tif", 0.0, 0.0, 0.0, 0.0, 0.0, None)]
    files.write_table(spark.createDataFrame(rows, "filename string, esd_1 double, esd_2 double, threshold_area double, threshold_area_otsu double, object_length double, max_points array<array<int>>"), str(tmp_path / "t"), header=False)
    (tmp_path / "t" / "printed.csv").write_text('c.tif,1,2,3,4,5,"(array([[62, 54]], dtype=int32), array([[78, 66]], dtype=int32))"\nd.tif,1,2,3,4,5,none\n')
    got = {r.filename: r.max_points for r in files.measures(spark, str(tmp_path / "t")).collect()}
    assert got == {"a.tif": [[62, 54], [78, 66]], "b.tif": None, "c.tif": [[62, 54], [78, 66]], "d.tif": None}


def test_images_of_one_name_are_an_error_unless_asked_for(spark, tmp_path):
    df = spark.createDataFrame([("a/x.tif", b"1"), ("b/x.tif", b"2"), ("y.tif", b"3")], "filename string, payload binary")
    with pytest.raises(ValueError, match="2 images are called x.tif"):
        files.write_images(df, str(tmp_path / "o"))
    assert not (tmp_path / "o").exists()
    files.write_images(df, str(tmp_path / "o"), prefix=F.lit("Class"), clash="overwrite")
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["Class-y.tif", "x.tif"]


def test_prefix_goes_before_the_name(spark, tmp_path):
    files.write_images(spark.createDataFrame([("x.tif", b"1", "Cat"), ("y.tif", b"2", None)], "filename string, payload binary, label string"), str(tmp_path / "o"), F.col("label"))
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["Cat-x.tif", "y.tif"]


def test_folders_recursively_and_single_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name in ("a.tif", "deep/b.tif", "deep/c.TIF", "deep/notes.txt"):
        (tmp_path / "in" / name).write_bytes(b"x")
    assert [r.filename for r in files.images(spark, str(tmp_path / "in")).collect()] == ["a.tif"]
    assert sorted(r.filename for r in files.images(spark, str(tmp_path / "in"), recursive=True).collect()) == ["a.tif", "b.tif"]
    assert [r.filename for r in files.tiffs(spark, str(tmp_path / "in" / "a.tif")).collect()] == ["a.tif"]
    assert packets.whole_images(spark, str(tmp_path / "in" / "deep")).count() == 3


def test_softmax_and_other_scalars(spark):
    rows = [([1.0, 2.0, 3.0], dt.datetime(2024, 1, 1, 0, 0, 59, 250000)), ([1000.0, 1000.0], START), ([], START), (None, START)]
    df = spark.createDataFrame(rows, "v array<double>, at timestamp")
    got = [r.s for r in df.select(scalars.softmax(F.col("v")).alias("s")).collect()]
    powers = [math.exp(x) for x in (1, 2, 3)]
    assert got[0] == pytest.approx([p / sum(powers) for p in powers]) and got[1] == [0.5, 0.5] and got[2:] == [[], None]
    row = df.select(scalars.next_boundary(F.col("at")).alias("b"), scalars.iso_stamp(F.col("at")).alias("i"), scalars.extent(F.lit(3), F.lit(2)).alias("e"), scalars.predicted(F.col("v"), ["a", "b", "c"]).alias("p")).first()
    assert row.b == dt.datetime(2024, 1, 1, 0, 1) and row.i == "2024-01-01T00:00:59.250000Z" and tuple(row.e) == (2, 3) and row.p == "c"


def test_softmax_takes_linear_time(spark):
    df = spark.range(200).select(F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda x: x / 1000.0).alias("v"))
    began = time.monotonic()
    df.select(F.array_max(scalars.softmax(F.col("v"))).alias("m")).agg(F.sum("m")).collect()
    assert time.monotonic() - began < 30  # work that grows with the square of the length takes minutes


def test_tags_and_their_names(spark):
    data = tiff.encode(disc(5), "2024:01:02 03:04:05", PLACE)
    df = spark.createDataFrame([(data,), (b"junk",)], "payload binary")
    got = [r.t for r in df.select(images.named_tags(images.tags("payload")).alias("t")).collect()]
    assert got[0]["ImageWidth"] == "120" and got[0]["DateTime"] == "2024:01:02 03:04:05" and "GPSInfo" in got[0] and got[1] is None
    place = df.limit(1).select(images.named_tags(images.gps_tags("payload"), images.GPS_TAG_NAMES).alias("t")).first().t
    assert (place["GPSLatitudeRef"], place["GPSLongitude"]) == ("S", "4 15 36")
    unknown = spark.range(1).select(images.named_tags(F.create_map(F.lit(60001), F.lit("x"))).alias("t")).first().t
    assert unknown == {"60001": "x"}
    sizes = [(r.e.width, r.e.length, r.e.datetime) for r in df.select(images.exif("payload").alias("e")).collect()]
    assert sizes == [(120, 120, "2024:01:02 03:04:05"), (None, None, None)]


def onnx_model() -> bytes:
    """A model written out by hand: the means of each channel (GlobalAveragePool, then Flatten)."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(k, v):
        return number(k << 3) + number(v) if isinstance(v, int) else number(k << 3 | 2) + number(len(v)) + v

    text = lambda k, s: field(k, s.encode())
    node = lambda kind, a, b: field(1, text(1, a) + text(2, b) + text(4, kind))
    shape = lambda *dims: field(2, b"".join(field(1, text(2, d) if isinstance(d, str) else field(1, d)) for d in dims))
    value = lambda name, *dims: text(1, name) + field(2, field(1, field(1, 1) + shape(*dims)))
    graph = node("GlobalAveragePool", "x", "m") + node("Flatten", "m", "y") + text(2, "g") + field(11, value("x", "n", 3, images.SIDE, images.SIDE)) + field(12, value("y", "n", 3))
    return field(1, 8) + field(7, graph) + field(8, text(1, "") + field(2, 13))


@pytest.mark.parametrize("way", ["path", "bytes", "added"])
def test_a_model_file_scores(spark, tmp_path, way):
    path = tmp_path / f"{way}.onnx"
    path.write_bytes(onnx_model())
    if way == "added":
        spark.sparkContext.addFile(str(path))
    scorer = {"path": lambda: images.OnnxScorer(str(path)), "bytes": lambda: images.OnnxScorer.of_file(str(path)), "added": lambda: images.OnnxScorer("added.onnx")}[way]()
    red = np.zeros((8, 8, 3), np.uint8)
    red[:, :, 0] = 255
    rows = [(tiff.encode(red),), (tiff.encode(red[:, :, ::-1].copy()),), (b"junk",)]
    got = [r.c for r in spark.createDataFrame(rows, "p binary").coalesce(1).select(images.classifier(scorer, ("r", "g", "b"))("p").alias("c")).collect()]
    assert [c.label for c in got] == ["r", "b", None]
    assert got[0].scores == pytest.approx([math.e / (math.e + 2), 1 / (math.e + 2), 1 / (math.e + 2)], abs=1e-4)


def test_one_pass_finds_what_single_functions_find(spark):
    rows = [(k, tiff.encode(disc(5 + k, tone=9 * k), "2024:01:01 00:00:00", PLACE) + bytes([200]) * 360) for k in range(9)] + [(50, b"junk"), (51, None)]
    df = spark.createDataFrame(rows, "k int, payload binary")
    fixed = df.withColumn("fixed", images.background_corrected("payload"))
    want = {r.k: r for r in fixed.select("k", images.positioned("payload").alias("p"), images.measured("fixed").alias("m"), images.classifier()("fixed").alias("c")).collect()}
    seen = df.select("k", images.viewer(batch=4)("payload").alias("s"))
    for r in seen.collect():
        w = want[r.k]
        assert (r.s.latitude, r.s.gps_ok, r.s.label, r.s.max_points) == (w.p.latitude, w.p.gps_ok, w.c.label if w.c else None, w.m.max_points)
        assert (r.s.esd_1, r.s.esd_2, r.s.object_length) == (w.m.esd_1, w.m.esd_2, w.m.object_length)
    plan = seen.select("k", "s.esd_1", "s.label", F.round("s.esd_2")).distinct()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("seen(payload") == 1
    only = df.select(images.viewer(classify=False, locate=False)("payload").alias("s")).collect()
    assert all(r.s.label is None and r.s.gps_ok is None and r.s.esd_1 is not None for r in only)
    assert imaging.enriched(df.select("payload", F.lit("n").alias("filename"), F.lit(START).alias("arrival")), imaging.Settings(classify=False)).columns == ["filename", "arrival", "position", "measures"]


@given(st.integers(0, 2**32 - 1))
@settings(max_examples=40, deadline=None)
def test_largest_part_of_noise(seed):
    mask = np.random.default_rng(seed).random((17, 23)) < 0.4
    labels = shapes.components(mask, corners=True)
    best, most = None, -1.0
    for k in range(1, labels.max() + 1):
        part = shapes.filled(labels == k)
        if shapes.area(part) > most:
            best, most = part, shapes.area(part)
    assert (shapes.largest(mask) == best).all()
    everything = np.argwhere(mask)[:, ::-1].astype(np.int64)
    assert shapes.diameter(shapes.row_ends(mask))[0] == shapes.diameter(everything)[0]
    assert shapes.largest(np.zeros((4, 4), bool)) is None


def test_widest_pair_of_a_group_over_many_batches(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), float(x), float(y)) for g, (x, y) in zip(rng.integers(0, 3, 3000), rng.normal(size=(3000, 2)), strict=True)] + [(7, 1.0, 1.0), (8, None, 1.0), (None, 0.0, 0.0), (None, 3.0, 4.0)]
    got = {r.g: (r.n_points, r.max_distance) for r in joins.widest_pairs(spark.createDataFrame(rows, "g int, x double, y double").repartition(40), "g", F.col("x"), F.col("y")).collect()}
    assert got[7] == (1, 0.0) and got[None] == (2, 5.0) and set(got) == {0, 1, 2, 7, None}
    for g in range(3):
        ps = np.array([(x, y) for a, x, y in rows if a == g])
        assert got[g] == (len(ps), pytest.approx(np.sqrt(((ps[:, None] - ps[None]) ** 2).sum(-1)).max()))


def test_collector_lands_what_comes(spark, tmp_path):
    sent = [d for d, _ in datagrams("c.tif", bytes(range(256)) * 8, 3, 77, START)]
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as server, socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as client:
        server.bind(("127.0.0.1", 0))
        came: list[int] = []
        worker = threading.Thread(target=lambda: came.append(collector.collect(server, str(tmp_path / "landed"), seconds=3, most=2, every=0.3)))
        worker.start()
        for d in sent:
            client.sendto(d, server.getsockname())
        worker.join(30)
    assert came == [len(sent)] and len(list((tmp_path / "landed").glob("*.parquet"))) >= 2
    (row,) = reassembly.reassembled(packets.decoded(packets.landed(spark, str(tmp_path / "landed")))).collect()
    assert (row.filename, bytes(row.payload)) == ("c.tif", bytes(range(256)) * 8)


def test_observed_counts_reach_the_log(spark, tmp_path):
    whole = packets.encoded(1, 0, 1, 1, packets.TAG_BODY, b"12345678")
    as_files(spark, [(whole, START), (whole[:9], START), (packets.encoded(1, 1024, 1, 1, 3, b""), START)], str(tmp_path / "landed"))
    log = monitor.logger(str(tmp_path / "log"), "tidestream-test")
    listener = monitor.Progress(log)
    spark.streams.addListener(listener)
    try:
        stream = packets.decoded(monitor.counted(packets.landed_stream(spark, str(tmp_path / "landed"))))
        stream.writeStream.format("noop").queryName("watched").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
        for _ in range(100):
            if "ended" in (text := (tmp_path / "log").read_text()):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
        logging.getLogger("tidestream-test").handlers.clear()
    assert '"query": "watched"' in text and '"came": 3, "malformed": 1, "rejected": 1' in text


def test_a_dead_queue_is_given_up_soon_and_a_restart_goes_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(publish, "PAUSE", 0.0)
    for k in range(3):
        spark.range(20 * k, 20 * k + 20).coalesce(1).select(F.col("id").alias("k"), F.lit("x").alias("payload")).write.mode("append").parquet(str(tmp_path / "in"))
    calls, up, box = tmp_path / "calls", tmp_path / "up", str(tmp_path / "box")

    def transport(key, message):
        with calls.open("a") as f:
            f.write(f"{key}\n")
        return up.exists()

    def run():
        stream = spark.readStream.schema("k long, payload string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        publish.published(stream, "k", box, transport, str(tmp_path / "c"), availableNow=True).awaitTermination(120)

    run()
    tries = calls.read_text().count("\n")
    assert 0 < tries <= 3 * 4 * publish.FAILURES * (1 + publish.TRIES)  # of 60 messages in three rounds of up to four tasks
    up.touch()
    spark.range(60, 61).coalesce(1).select(F.col("id").alias("k"), F.lit("x").alias("payload")).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    sent = spark.read.option("recursiveFileLookup", True).schema("key string").parquet(f"{box}/sent")
    assert sorted(int(r.key) for r in sent.collect()) == list(range(61))
    assert spark.read.parquet(f"{box}/left/3").count() == 0
