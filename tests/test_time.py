"""Matching and filling by time, rows that are turned away, and things that come twice."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tests.test_state import ran
from tests.test_streams import LABELS, START, controls, datagrams, events
from tidestream import schemas as S
from tidestream.operators import joins, windows
from tidestream.sources import files, packets, quarantine
from tidestream.streaming import dedup

MINUTE = dt.timedelta(minutes=1)


def test_the_next_mark_is_found_over_empty_hours(spark):
    rnd = random.Random(3)
    marks = sorted({START + dt.timedelta(seconds=rnd.randrange(0, 40 * 3600)) for _ in range(25)})
    rows = [(k, START + dt.timedelta(seconds=rnd.randrange(-3600, 41 * 3600))) for k in range(150)] + [(900, None), (901, marks[0]), (901, marks[0]), (902, marks[-1]), (903, marks[-1] + MINUTE)]
    a = spark.createDataFrame(rows, "k int, at timestamp")
    b = spark.createDataFrame([(m, i) for i, m in enumerate(marks)], "mark timestamp, which int")
    want = [(k, at, *next(((m, i) for i, m in enumerate(marks) if at and m >= at), (None, None))) for k, at in rows]
    for unit in ("hour", "day"):
        assert sorted(map(tuple, joins.next_at(a, "at", b, "mark", unit).collect()), key=str) == sorted(want, key=str)
    assert joins.next_at(a, "at", b.limit(0), "mark").filter("which is not null").count() == 0


def closed_windows(spark, rows):
    return windows.sequenced(windows.wide_counts(spark.createDataFrame(rows, "arrival timestamp, label string, value double"), LABELS))


def both_ways(spark, rows):
    control = spark.createDataFrame(controls(), "arrival timestamp, text string")
    closed = closed_windows(spark, rows)
    place = dict(closed.select("win_seq", "minute").collect())
    positional = windows.corrections(files.control_rows(windows.control_sequence(control, closed)))
    event = windows.event_corrections(files.control_rows(control), closed)
    return {place[r.win_seq]: (r.hits, r.misses) for r in positional.collect()}, {r.minute: (r.hits, r.misses) for r in event.collect()}, set(place.values())


def test_matching_by_time_differs_from_matching_by_closes_after_gaps_only(spark):
    dense = [(START + m * MINUTE, rnd, 1.0) for m in range(40) for rnd in LABELS]
    positional, event, there = both_ways(spark, dense)
    assert {k: v for k, v in event.items() if k in there} == positional and len(positional) > 20
    gap = [r for r in dense if not 10 <= (r[0] - START) // MINUTE < 16]
    positional, event, there = both_ways(spark, gap)
    differ = {m for m in there if positional.get(m) != event.get(m)}
    assert differ and max(differ) < START + 26 * MINUTE and min(differ) < START + 10 * MINUTE  # a control after the gap speaks of minutes, not of closes


def brute_events(rows, texts):
    minutes = sorted({at.replace(second=0, microsecond=0) for at, *_ in rows})
    best = {}
    for at, text in texts:
        lines = [x for x in text.split("\n") if x.strip()]
        closes = next((m for m in minutes if m >= at.replace(second=0, microsecond=0)), None)
        for n, line in enumerate(lines if len(lines) == 10 and closes else [], 1):
            hits, misses = map(int, line.split(","))
            if hits > 0:
                best[closes - (10 - n) * MINUTE] = max(best.get(closes - (10 - n) * MINUTE, (START - 90 * MINUTE,)), (at, n, hits, misses))
    return {m: v[2:] for m, v in best.items()}


def test_event_corrections_are_those_of_brute_force(spark):
    rows = events()
    found = windows.event_corrections(files.control_rows(spark.createDataFrame(controls(), "arrival timestamp, text string")), closed_windows(spark, rows))
    assert {r.minute: (r.hits, r.misses) for r in found.collect()} == brute_events(rows, controls())


def test_a_calendar_has_every_minute(spark):
    rnd = random.Random(9)
    places = sorted(rnd.sample(range(5000), 60))
    rows = [(START + m * MINUTE, rnd.randint(1, 9), rnd.choice([None, rnd.random()]), "x") for m in places]
    df = spark.createDataFrame(rows, "minute timestamp, n int, latitude double, note string").repartition(3)
    known, want, by = None, [], {r[0]: r for r in rows}
    for m in range(places[0], places[-1] + 1):
        at = START + m * MINUTE
        _, n, latitude, note = by.get(at, (at, 0, None, None))
        known = known if latitude is None else latitude
        want.append((at, n, known, note, at not in by))
    for unit in ("hour", "day"):
        assert sorted(map(tuple, windows.calendar(df, ["n"], ["latitude"], unit=unit).collect()), key=str) == sorted(want, key=str)
    assert windows.calendar(df.limit(0), ["n"], ["latitude"]).count() == 0
    assert windows.calendar(df).filter("idle").count() == len(want) - len(rows)


def test_packets_are_taken_or_turned_away_with_a_reason(spark, tmp_path):
    good = datagrams("a.tif", b"x" * 2000, 3, 2**63 + 1, START)
    bad = [(None, START), (b"short", START), (good[0][0][:-1], START), (packets.encoded(1, 1024, 1, 2000, 3, b"q"), START), (b"", None)]
    rows = packets.judged(spark.createDataFrame(good + bad, S.DATAGRAM))
    counts = quarantine.parted(rows, str(tmp_path / "q"))
    assert counts == {"came": len(good) + 5, "accepted": len(good), "rejected": 5}
    back = spark.read.parquet(str(tmp_path / "q"))
    assert back.filter("not rejected").count() == len(good)
    assert dict(map(tuple, quarantine.reasons(back).collect())) == {packets.MISSING: 1, packets.SHORT: 2, packets.TORN: 1, packets.OUT_OF_RANGE: 1}
    assert sorted(map(tuple, packets.decoded(quarantine.accepted(rows)).collect())) == sorted(map(tuple, packets.decoded(spark.createDataFrame(good, S.DATAGRAM)).collect()))


def test_columns_make_the_datagrams_that_python_makes(spark):
    rows = [(k, k % 3, 2**40 + k, 5, 3, bytes([k]) * k, 2**32 - 1 - k) for k in range(60)]
    df = spark.createDataFrame(rows, "field long, part long, unique_id long, total long, tag long, body binary, hash long")
    made = df.select(packets.packed(*(F.col(c) for c in df.columns)))
    assert sorted(bytes(r[0]) for r in made.collect()) == sorted(packets.encoded(f, p, u, t, g, b, h) for f, p, u, t, g, b, h in rows)


def test_control_lines_are_taken_or_turned_away_with_a_reason(spark):
    ten = [f"{k},{k}" for k in range(10)]
    wrong = [*ten[:4], "4,4,4", "x,5", " 6 , 6 ", "7", "8,", "9,1e3"]
    texts = [(1, "\n".join(ten)), (2, "\r\n\n".join(wrong)), (3, "1,1\n2,2"), (4, None), (5, ""), (6, "\n".join([*ten, "1,1"]))]
    df = spark.createDataFrame([(k, START, t) for k, t in texts], "line_ int, arrival timestamp, text string")
    got = {(r.line_, r.n): (r.hits, r.misses, r.reason) for r in quarantine.judged_controls(df).collect()}
    assert len(got) == 24 and all(got[1, k + 1] == (k, k, None) for k in range(10))
    assert [got[2, n][2] for n in range(1, 11)] == [None] * 4 + [quarantine.WIDTH, quarantine.NUMBERS, None, quarantine.WIDTH, quarantine.NUMBERS, quarantine.NUMBERS] and got[2, 7][:2] == (6, 6)
    assert {got[k, None] for k in (3, 4, 5, 6)} == {(None, None, quarantine.LINES)}
    taken = quarantine.accepted(quarantine.judged_controls(df)).select("line_", "n", "hits", "misses")
    plain = files.control_rows(df).filter("hits is not null and misses is not null and line_ = 1").select("line_", "n", "hits", "misses")
    assert sorted(map(tuple, taken.filter("line_ = 1").collect())) == sorted(map(tuple, plain.collect()))


def test_tables_of_measurements_are_taken_or_turned_away_with_a_reason(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        'a.tif,1,2,3,4,5,"[[62,54],[78,66]]"\nb.tif,0,0,0,0,0,\nc.tif,1,2,3,4,5,"(array([[62, 54]], dtype=int32), array([[78, 66]], dtype=int32))"\n'
        "d.tif,1,2,3,4,5,none\ne.tif,1,x,3,4,5,\nf.tif,1\n,1,2,3,4,5,\n"
    )
    rows = quarantine.judged_measures(spark, str(tmp_path / "t.csv"))
    counts = quarantine.parted(rows, str(tmp_path / "q"))
    assert counts == {"came": 7, "accepted": 3, "rejected": 4}
    back = spark.read.parquet(str(tmp_path / "q"))
    assert {r.filename: r.max_points for r in back.filter("not rejected").collect()} == {"a.tif": [[62, 54], [78, 66]], "b.tif": None, "c.tif": [[62, 54], [78, 66]]}
    assert dict(map(tuple, quarantine.reasons(back).collect())) == {quarantine.NO_POINTS: 1, quarantine.UNREADABLE: 2, quarantine.NO_NAME: 1}


def test_what_comes_twice_in_a_stream_is_told_and_forgotten_in_time(spark, tmp_path):
    later = START + dt.timedelta(hours=3)
    lots = [
        [("a", START), ("b", START + MINUTE), ("a", START + 2 * MINUTE)],
        [("a", START + 3 * MINUTE), ("c", later)],
        [("a", later), ("c", later + MINUTE), ("d", later)],
    ]
    held = []
    for lot in lots:  # each a restart of the receiver
        spark.createDataFrame(lot, "key string, received timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("key string, received timestamp").parquet(str(tmp_path / "in"))
        found, query = ran(dedup.messages_once(stream), spark, tmp_path, "once")
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert sorted(r.key for r in found.collect()) == ["a", "a", "b", "c", "d"]  # a comes again after three hours, as another
    assert held[1] < 3 + 1 and held[2] <= 3  # what is older than the watermark is forgotten


def test_packets_that_are_sent_again_are_dropped(spark, tmp_path):
    sent = datagrams("a.tif", b"x" * 3000, 3, 77, START)
    for lot in (sent, sent[::2] + datagrams("b.tif", b"y", 3, 78, START)):
        spark.createDataFrame(lot, S.DATAGRAM).coalesce(1).write.mode("append").parquet(str(tmp_path / "landed"))
        once = dedup.packets_once(packets.decoded(packets.landed_stream(spark, str(tmp_path / "landed"))))
        found, _ = ran(once, spark, tmp_path, "packets")
    assert found.count() == len(sent) + 2 == found.select("unique_id", "part").distinct().count()
