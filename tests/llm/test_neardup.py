import itertools
import random
import re

import numpy as np
import pytest

from tidestream.llm import common, neardup

SCHEMA = "doc_id long, text string, node string, bands int"


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, size=2, percent=80):
    sets = {d: shingles(t, size) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets.items())


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in neardup.grouped(df, **kw).collect())


def corpus(seed, families=12, per=10, rate=(0.0, 0.1)):
    rnd = random.Random(seed)
    vocab = [f"v{i}é" for i in range(400)]
    rows, d = [], 0
    for _ in range(families):
        base = rnd.choices(vocab, k=rnd.randint(1, 90))
        for _ in range(rnd.randint(1, per)):
            p = rnd.uniform(*rate)
            rows.append((d * 37 % 1009 - 5, " ".join(rnd.choice(vocab) if rnd.random() < p else w for w in base)))
            d += 1
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block": 3, "visitors": 2}])
def test_components_match_brute_force(spark, sizes):
    rows = corpus(1) + [(2000, None), (2001, ""), (2002, " \n"), (2003, "One"), (2004, "one"), (2005, "ONE two"), (2006, "one Two")]
    assert run(spark, rows, **sizes) == brute(rows)


@pytest.mark.parametrize("sizes", [{}, {"block": 8, "visitors": 5}])
def test_borderline_family_of_many_members(spark, sizes, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0 if sizes else 20_000)
    monkeypatch.setattr(neardup, "PIVOT_PAIRS", 3 if sizes else 5_000)
    rows = corpus(7, families=2, per=80, rate=(0.02, 0.07))
    assert run(spark, rows, **sizes) == brute(rows)


def brute_repeated(rows, size=2, percent=80):
    """Components of rows with repeated doc_ids: a doc_id is linked by what any of its rows is linked by."""
    sets = [(d, shingles(t, size)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def test_rows_of_one_doc_id_that_copy_and_differ(spark):
    words = lambda c, n=40: [f"{c}{i}" for i in range(n)]
    a, b, near = " ".join(words("a")), " ".join(words("b")), " ".join([*words("b")[:-1], "z"])
    rows = [(3, a), (5, a), (5, b), (9, near), *((d, b) for d in range(11, 40))]
    assert run(spark, rows) == brute_repeated(rows)
    assert {r[0]: r[2] for r in run(spark, rows)}[9] == 3


@pytest.mark.parametrize("sizes", [{}, {"block": 3, "visitors": 2}])
def test_repeated_doc_ids_match_brute_force(spark, sizes):
    for seed in (11, 12):
        rnd = random.Random(seed)
        rows = corpus(seed, families=10, per=12, rate=(0.0, 0.07))
        rows = [(rnd.randrange(70), t) for _, t in rows]
        rows += [(rnd.randrange(70, 75), t) for _, t in rnd.sample(rows, 20)] + [(80, None), (80, ""), (80, rows[0][1])]
        assert run(spark, rows, **sizes) == brute_repeated(rows)


def test_pairs_of_a_hot_pivot_are_dealt_to_tasks(spark):
    most, members = 500, 12_000
    rows = spark.range(members).selectExpr("7L as high_a", "id as b", "id * 31 as high_b").unionByName(spark.range(300).selectExpr("id + 100 as high_a", "id as b", "-id as high_b"))
    pairs, hot = neardup._dealt(rows.checkpoint(), most)
    held = {(r.high_a, r.part): r["count"] for r in pairs.groupBy("high_a", "part").count().collect()}
    assert sum(held.values()) == members + 300 and max(held.values()) <= 1.3 * most
    assert {p for a, p in held if a != 7} == {0}
    pivots = neardup._in_parts(rows.select("high_a").distinct(), hot)
    assert sorted((r.high_a, r.part) for r in pivots.collect()) == sorted(held)


def test_long_text_and_empty_table(spark):
    long = " ".join(f"a{i % 7919} b{i % 13}" for i in range(60_000))
    rows = [(5, long), (3, long + " tail"), (9, "short one")]
    assert run(spark, rows) == brute(rows)
    assert neardup.grouped(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one_keeps_columns(spark):
    rows = [(4, "a b c d", "x", 1), (2, "A b c d", None, 2), (7, None, "z", 3), (None, "a b c d", "q", 4)]
    got = neardup.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "node", "bands"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[3]) == rows[1:]


def test_signature_slots_estimate_similarity():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    other = np.concatenate([base[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    for n in (1, 5, 50, 1000):
        a, b = neardup.super_minhash([np.unique(base[:n]), np.unique(base[:n])], 200)
        assert (a == b).all() and (a != np.iinfo(np.uint64).max).all()
    a, b = neardup.super_minhash([np.unique(base), np.unique(other)], 200)
    assert abs((a == b).mean() - 800 / 1200) < 0.12


@pytest.mark.parametrize("shape", ["path", "star", "sparse", "none"])
def test_components_of_links(spark, shape):
    rnd = random.Random(6)
    n = 300
    names = rnd.sample(range(10_000), n)
    links = {"path": [(i, i + 1) for i in range(n - 1)], "star": [(n - 1, i) for i in range(n - 1)], "sparse": [(rnd.randrange(n), rnd.randrange(n)) for _ in range(200)], "none": []}[shape]
    links = [(names[a], names[b]) for a, b in links]
    parent = {x: x for x in names}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = neardup.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in names if find(x) != x)
