"""Sinks that commit once, and containers that are read in ranges."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tests.test_streams import START
from tidestream.sources import bins, commits, files, shared

IMAGES = "filename string, payload binary, arrival timestamp"


def pictures(n, first=0):
    return [(f"i{k:03d}.tif", bytes([k % 256]) * (k % 50 + 1), START + dt.timedelta(minutes=k % 35)) for k in range(first, first + n)]


def in_bins(spark, path):
    return sorted((r.filename, bytes(r.payload)) for r in bins.read(spark, str(path)).collect())


def in_folder(path):
    return sorted((p.name, p.read_bytes()) for p in path.iterdir() if p.is_file())


class Killed(Exception):
    pass


def dying(monkeypatch, after):
    """The process dies in a commit after so many files were moved."""
    moved, move = [], shared.move_if_there

    def once(old, new):
        if len(moved) >= after:
            raise Killed
        moved.append(new)
        move(old, new)

    monkeypatch.setattr(shared, "move_if_there", once)
    monkeypatch.setattr(commits, "MOVERS", 1)


@pytest.mark.parametrize("kind", ["bins", "images"])
@pytest.mark.parametrize("after", [0, 2])
def test_a_batch_that_dies_in_its_commit_and_runs_again_leaves_each_image_once(spark, tmp_path, monkeypatch, kind, after):
    make = {"bins": bins._BinStreamWriter, "images": files._ImageStreamWriter}[kind]
    folder = tmp_path / "out"
    rows = [{"filename": f, "payload": p, "bin": f"pi-{k // 3}.bin"} for k, (f, p, _) in enumerate(pictures(12))]

    def written():
        writer = make(str(folder), "s")
        return writer, [writer.write(iter(rows[k::2])) for k in range(2)]

    first, messages = written()
    with monkeypatch.context() as m:
        dying(m, after)
        with pytest.raises(Killed):
            first.commit(messages, 4)
    again, messages = written()  # the restarted query runs the batch again
    again.commit(messages, 4)
    third, messages = written()
    third.commit(messages, 4)
    got = in_bins(spark, folder) if kind == "bins" else in_folder(folder)
    assert got == sorted((r["filename"], r["payload"]) for r in rows)
    assert [p.name for p in folder.iterdir() if p.name.startswith("_staged")] == []
    other, messages = written()
    other.abort(messages, 5)
    assert (in_bins(spark, folder) if kind == "bins" else in_folder(folder)) == got


def test_a_commit_that_was_broken_off_is_finished_by_the_next_job(spark, tmp_path, monkeypatch):
    folder = tmp_path / "out"
    writer = files._ImageWriter(str(folder))
    message = writer.write(iter({"filename": f, "payload": p} for f, p, _ in pictures(6)))
    with monkeypatch.context() as m:
        dying(m, 3)
        with pytest.raises(Killed):
            writer.commit([message])
    assert len(in_folder(folder)) == 3
    files.write_images(spark.createDataFrame(pictures(4, 10), IMAGES), str(folder))
    assert [n for n, _ in in_folder(folder)] == sorted(f for f, _, _ in pictures(6) + pictures(4, 10))


def test_a_job_that_dies_before_its_commit_leaves_nothing_to_readers(spark, tmp_path):
    writer = files._ImageWriter(str(tmp_path / "out"))
    writer.write(iter([{"filename": "a.tif", "payload": b"1"}]))
    assert files.images(spark, str(tmp_path / "out")).count() == 0


def test_jobs_with_a_key_are_committed_once(spark, tmp_path):
    df = spark.createDataFrame(pictures(20), IMAGES)
    for _ in range(2):
        bins.write(df, str(tmp_path / "bins"), key="2024-01-01")
        files.write_images(df, str(tmp_path / "files"), key="2024-01-01")
    want = sorted((f, p) for f, p, _ in pictures(20))
    assert in_bins(spark, tmp_path / "bins") == want == in_folder(tmp_path / "files")
    bins.write(df, str(tmp_path / "bins"), key="2024-01-02")
    assert len(in_bins(spark, tmp_path / "bins")) == 40


def test_streams_of_images_are_written_once_across_restarts(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame(pictures(10, 10 * k), IMAGES).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        images = spark.readStream.schema(IMAGES).parquet(str(tmp_path / "in"))
        bins.stream(images, str(tmp_path / "bins"), "s", str(tmp_path / "c1"), availableNow=True).awaitTermination(120)
        files.stream_images(images, str(tmp_path / "files"), "s", str(tmp_path / "c2"), F.lit("Cat"), availableNow=True).awaitTermination(120)
    want = sorted((f, p) for f, p, _ in pictures(30))
    assert in_bins(spark, tmp_path / "bins") == want and in_folder(tmp_path / "files") == [(f"Cat-{f}", p) for f, p in want]
    # the commit log of the last batch is lost: Spark runs it again
    for c in ("c1", "c2"):
        for p in (tmp_path / c / "commits").iterdir():
            if p.name.strip(".").startswith("2"):
                p.unlink()
    images = spark.readStream.schema(IMAGES).parquet(str(tmp_path / "in"))
    bins.stream(images, str(tmp_path / "bins"), "s", str(tmp_path / "c1"), availableNow=True).awaitTermination(120)
    files.stream_images(images, str(tmp_path / "files"), "s", str(tmp_path / "c2"), F.lit("Cat"), availableNow=True).awaitTermination(120)
    assert in_bins(spark, tmp_path / "bins") == want and len(in_folder(tmp_path / "files")) == 30


def test_a_large_bin_is_read_by_several_tasks_and_filters_leave_bins_out(spark, tmp_path):
    rows = [(f"i{k}.tif", bytes([k % 256]) * 5000) for k in range(300)]
    for name, part in (("pi-2024-01-01-00-00.bin", rows), ("pi-2024-01-01-00-10.bin", rows[:40]), ("pi-2024-01-01-01-00.bin", rows[:1])):
        (tmp_path / name).write_bytes(b"".join(bins.framed(n, p) for n, p in part))
    with (tmp_path / "pi-2024-01-01-01-10.bin").open("wb") as f:
        f.write(bins.framed("whole", b"1") + bins.framed("torn", b"22")[:-1])
    (tmp_path / "pi-2024-01-01-01-20.bin").write_bytes(b"")
    found = bins.read(spark, str(tmp_path), most=100_000)
    assert found.rdd.getNumPartitions() == 15 + 2 + 1 + 1
    assert sorted((r.bin[-8:], r.filename, bytes(r.payload)) for r in found.collect()) == sorted([*(("0-00.bin", *r) for r in rows), *(("0-10.bin", *r) for r in rows[:40]), ("1-00.bin", *rows[0]), ("1-10.bin", "whole", b"1")])
    one = found.filter(F.col("bin").endswith("00-10.bin"))
    assert one.rdd.getNumPartitions() == 2 and one.count() == 40
    plan = one._jdf.queryExecution().toString()
    assert "StringEndsWith" in plan or "EndsWith" not in plan.split("== Physical Plan ==")[1]  # no task filters rows by bin
    late = found.filter((F.col("bin") > f"file://{tmp_path}/pi-2024-01-01-00-10.bin") & (F.length("payload") < 10))
    assert late.rdd.getNumPartitions() == 2 and [r.filename for r in late.collect()] == ["whole"]
    assert found.filter(F.col("bin") == "none").count() == 0
    assert sum(json.loads(x).get("records", 0) for x in bins.ranges(spark, str(tmp_path)).toJSON().collect()) == 342


def test_small_bins_are_one_file_each_and_share_the_tasks_that_read_them(spark, tmp_path):
    rows = [(f"i{k}.tif", b"%d" % k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k)) for k in range(9000)]
    bins.write(spark.createDataFrame(rows, IMAGES).repartition(5), str(tmp_path / "bins"))
    assert len(list((tmp_path / "bins").glob("*.bin"))) == 900
    found = bins.read(spark, str(tmp_path / "bins"), most=1 << 14)
    assert found.rdd.getNumPartitions() <= 2 * bins.TASKS
    assert sorted((r.filename, bytes(r.payload)) for r in found.collect()) == sorted((f, p) for f, p, _ in rows)
    day = found.filter(F.col("bin").contains("pi-2024-01-03-"))
    assert day.count() == 24 * 60 and {r.bin.split("pi-")[1][:10] for r in day.select("bin").collect()} == {"2024-01-03"}
