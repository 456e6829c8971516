import hashlib
import random
import zlib

from hypothesis import given
from hypothesis import strategies as st

from tidestream.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, size int"


@given(st.lists(st.lists(st.integers(0, 9)).map(sorted), max_size=9))
def test_loser_tree_merges_stably(runs):
    got = list(warc.merge([[(x, i) for x in r] for i, r in enumerate(runs)], lambda x: x[0]))
    assert got == sorted(((x, i) for i, r in enumerate(runs) for x in r))


def test_archives_hold_the_pages(spark, tmp_path):
    rnd = random.Random(3)
    shared = ["é" * 50, "b" * 99, "c" * 5000, "WARC/1.1\r\n\r\n" * 30]
    rows = [(i * 7 % 211, f"https://www.S{i % 5}.example.org/P?q={i}", rnd.choice([*shared, f"own {i} " * rnd.randint(0, 60)])) for i in range(200)]
    rows += [(900, None, None), (901, "bad url\r\nX: y", ""), (902, "http://[", "\r\n\r\n" * 40), (903, "u", "x" * 2_000_000), (904, "u", shared[0]), (904, "u", shared[0])]
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA).repartition(4)
    got = warc.archived(df, f"file://{tmp_path}/w").collect()
    first = {}
    for d, _, h in rows:
        h = (h or "").encode()
        first[h] = min(first.get(h, d), d)
    want = []
    for d, _, h in rows:
        h = (h or "").encode()
        again = len(h) >= 100 and first[h] != d
        want.append((d, len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    order = [(r.url_key, r.captured, r.page_id) for r in got]
    assert order == sorted(order)
    records = [x for p in (tmp_path / "w").glob("*.txt.gz") for x in warc.parse(zlib.decompress(p.read_bytes(), 31))]
    payloads = {int(h["WARC-Record-ID"][10:-1]): bytes(b).split(b"\r\n\r\n", 1)[1] for h, b in records if h["WARC-Type"] == "response"}
    assert all(payloads[d] == (h or "").encode() for d, _, h in rows if d in payloads)


def test_null_id_and_empty_table(spark):
    rows = [(None, "u", "p" * 200), (1, "u", "p" * 200), (2, "u", "p" * 200)]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str) == [(1, "response", None), (2, "revisit", 1), (None, "response", None)]
    assert warc.archived(spark.createDataFrame([], SCHEMA)).count() == 0


@given(st.lists(st.tuples(st.lists(st.sampled_from(["\r\n", "\r", "\n", "x", "\r\n\r\n"]), max_size=9).map("".join), st.booleans()), max_size=6))
def test_lines_give_back_the_records(parts):
    made, want = b"", []
    for text, revisit in parts:
        block = b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\n" + text.encode()
        made += f"WARC/1.1\r\nWARC-Type: {revisit}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + warc.GAP
        want.append((str(revisit), block))
    assert [(h["WARC-Type"], b) for h, b in warc.parse(made)] == want


def test_long_archives_are_read_as_a_stream_and_merged_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PART_ENTRIES", 40)
    monkeypatch.setattr(warc, "RECORDS_PER_ARCHIVE", 90)
    monkeypatch.setattr(warc, "BLOCK", 3)
    rnd = random.Random(8)
    rows = []
    for d in range(400):
        text = "".join(rnd.choice(["\r\n\r\n", "\r\n", "\r", "\n", "a" * rnd.randint(1, 400), "\r\n\r\r\n\r\n"]) for _ in range(rnd.randint(0, 60)))
        rows.append((d, f"http://h{d % 7}.org/{rnd.randint(0, 50)}", text * (40 if d % 50 == 0 else 1)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = warc.archived(df, f"file://{tmp_path}/w").collect()
    assert len(list((tmp_path / "w").glob("*.gz"))) == 5
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == sorted((d, len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for d, _, t in rows)
    order = [(r.url_key, r.captured, r.page_id) for r in got]
    assert order == sorted(order)


def test_a_broken_archive_is_an_error():
    for data in (b"x\r\n\r\n", b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcdefgh\r\n\r\n"):
        try:
            list(warc.parse(data))
        except ValueError:
            continue
        raise AssertionError(data)
