import hashlib
import math
import random

import pytest

from tidestream.llm import mixing

SCHEMA = "doc_id long, source string, text string, size string, bucket int"


def brute(rows):
    size = lambda t: len((t or "").encode().split())
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r[2]) for r in rows if r[1] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    whole, full = 1.5 * sum(total.values()), set()
    while True:
        level = (whole - sum(2 * total[s] for s in full)) / (sum(weight[s] for s in sources if s not in full) or 1)
        over = {s for s in sources if s not in full and level * weight[s] > 2 * total[s]}
        if not over:
            break
        full |= over
    target = {s: 2.0 * total[s] if s in full else level * weight[s] for s in sources}
    out = []
    for s in sources:
        docs = sorted((hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), r[0] or 0, size(r[2]), r[0]) for r in rows if r[1] == s)
        at, goal = 0, math.floor(target[s])
        for _, _, n, d in docs:
            clip = lambda done, n=n: max(0, min(n, goal - done))
            out.append((d, n, total[s], target[s], clip(at) + clip(at + total[s])))
            at += n
    return sorted(out, key=str)


def rows_of(n, seed):
    rnd = random.Random(seed)
    names = ["b", "a", "Z", None, "é", "￿", "🙂"]
    return [(i, rnd.choices(names, [9, 1, 2, 3, 1, 1, 1])[0], rnd.choice([None, "", " \n"]) if rnd.random() < 0.05 else " ".join(["w"] * rnd.randint(1, 60))) for i in range(n)]


@pytest.mark.parametrize("rows", [rows_of(400, 1), rows_of(5, 2), [(1, "a", None)], [(1, "a", "x y"), (1, "a", "x y"), (None, None, "z " * 50_000)]])
def test_matches_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "q", 7) for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in mixing.mixed(df).collect()]
    want = brute(rows)
    for g, w in zip(sorted((x[:5] for x in got), key=str), want, strict=True):
        assert g[:3] == w[:3] and g[4] == w[4] and g[3] == pytest.approx(w[3])
    first = [x[5] for x in got if x[5] is not None]
    assert first == sorted(first) and all(0 <= x <= 1 for x in first)
    assert all((x[6] is None) or x[6] >= x[5] for x in got)


def test_empty_table(spark):
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
