import random
import re
from collections import Counter

from tidestream.llm import common, quality

SCHEMA = "doc_id long, text string, source string, host string, kept int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = Counter(windows)
    covered = {j for i, x in enumerate(windows) if many[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), rep, n < 10 or 100 * rep > 20 * n


def texts():
    rnd = random.Random(4)
    for _ in range(150):
        vocab = [f"é{i}" for i in range(rnd.choice([2, 6, 40, 400]))] + ["#a", "<b>", "&"]
        yield "".join(rnd.choice(vocab) + rnd.choice([" ", " ", " ", "\n", "\t ", "\x0b", " ", "\n\n"]) for _ in range(rnd.randint(0, 120)))
    yield from [None, "", " \n ", "a", "a b c d", "a b c d e", "x " * 30_000, "same line\n" * 500, "ö" * 40_000]


def test_features_match_brute_force(spark):
    rows = [(i, t, f"s{i % 3}", "h", 1) for i, t in enumerate(texts())]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = {r.doc_id: tuple(r[n] for n in names) for r in quality.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {r[0]: brute(r[1]) for r in rows}


def test_bad_hosts_take_their_documents_with_them(spark, monkeypatch):
    good, bad = " ".join(f"w{i}" for i in range(30)), "a b"
    rows = [(i, good if i % 10 else bad, "fine", None, 0) for i in range(200)]
    rows += [(1000 + i, bad if i % 10 else good, "poor", None, 0) for i in range(200)]
    rows += [(2000, good, None, None, 0), (2001, bad, None, None, 0), (None, bad, "fine", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted([r[0] for r in rows if r[1] == good and r[2] != "poor"])
    assert sorted(r.doc_id for r in quality.judged(df).filter("kept").collect()) == want
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == want
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)  # the salted join
    assert sorted(r.doc_id for r in quality.judged(df).filter("kept").collect()) == want
    empty = quality.judged(df.limit(0))
    assert empty.count() == 0


def test_rows_of_one_doc_id_are_judged_each(spark, monkeypatch):
    good, bad = " ".join(f"w{i}" for i in range(30)), "a b"
    rows = [(None, good, "s", "h", 1), (None, bad, "s", "h", 2), (None, good, None, None, 3), (7, good, "s", None, 4), (7, bad, "s", "h", 5), (8, None, "s", "h", 6)]
    rows += [(100 + i, good, "s", "h", 10 + i) for i in range(20)]
    for most in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        kept = quality.keep_good(spark.createDataFrame(rows, SCHEMA).repartition(3))
        assert sorted((tuple(r) for r in kept.collect()), key=lambda r: r[4]) == [r for r in rows if r[1] == good]
