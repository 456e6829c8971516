import hashlib
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidestream.llm import fim, oracles, queries

MARKS = (fim.PREFIX, fim.SUFFIX, fim.MIDDLE)
PIECES = {"character": r"(?s).", "word": r"[ \t-\r]*[^ \t-\r]+[ \t-\r]*|[ \t-\r]+", "line": r"[^\n]*\n|[^\n]+"}


def parts(text, unit):
    return re.findall(PIECES[unit], text)


def brute(doc_id, text, unit="character"):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    found = parts(text, unit)
    n = len(found)
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (found[:a], found[a:b], found[b:]))
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def texts():
    rnd = random.Random(5)
    letters = "ab <>PSM\n\té漢😀́\x00"
    out = ["".join(rnd.choice(letters) for _ in range(rnd.choice((1, 5, 127, 128, 129, 700)))) for _ in range(80)]
    return [*out, None, "", "<P>", "a<S>b", "<<M>", "<P", "x" * 128, "é" * 5000, "<P<S", "ab " * 60000, " \n ", *out[:3]]


@pytest.mark.parametrize("unit", sorted(PIECES))
def test_transformation_is_that_of_brute_force(spark, unit):
    rows = [(i % 90 if i != 7 else None, t, i) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output int")
    made = fim.transformed(docs, unit=unit).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = [tuple(r) for r in made.collect()]
    want = [(*brute(d, t, unit), t or "") for d, t, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_no_documents(spark):
    assert fim.digests(fim.transformed(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_other_sentinels_and_shares(spark):
    docs = spark.createDataFrame([(i, f"der text {i}") for i in range(50)], "doc_id int, text string")
    marks = ("<|vorn|>", "<|hinten|>", "<|mitte|>")
    made = fim.transformed(docs, plain=0, suffix_first=100, sentinels=marks)
    assert {(r.form, r.output.startswith(marks[1])) for r in made.collect()} == {("spm", True)}
    assert sorted(r[0] for r in made.select(fim.restored(F.col("output"), F.col("form"), marks)).collect()) == sorted(f"der text {i}" for i in range(50))
    with pytest.raises(ValueError, match="end with"):
        fim.Automaton(("ab", "ba"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("<PSM>a é\n😀"), max_size=300), max_size=6))
def test_one_scan_counts_units_and_sentinels(found):
    data = [t.encode() for t in found]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
    buffer = np.frombuffer(b"".join(data), np.uint8)
    for unit in PIECES:
        scan = fim.Scan(fim.Automaton(MARKS, unit), buffer, offsets)
        assert scan.units.tolist() == [len(parts(t, unit)) for t in found]
        assert scan.hits.tolist() == [len(re.findall("<[PSM]>", t)) for t in found]
        asked = [(i, k) for i, t in enumerate(found) for k in range(len(parts(t, unit)) + 1)]
        if asked:
            i, k = np.array(asked).T
            ends = [int(offsets[a] + len("".join(parts(found[a], unit)[:b]).encode())) for a, b in asked]
            assert scan.cuts(i, k).tolist() == ends


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
def test_query_gives_what_its_sql_gives(spark):
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    want = con.execute(f"SELECT {', '.join(names)} FROM ({oracles.FILL})").fetchall()
    assert sorted(map(tuple, queries.fill_in_middle(spark, str(DATA)).select(names).collect())) == sorted(want)
