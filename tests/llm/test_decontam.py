import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidestream.llm import decontam


def sellers(item, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        cur = [i]
        for j, d in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (c != d), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


@settings(max_examples=300, deadline=None)
@given(st.text("abé", min_size=1, max_size=90), st.text("abé", max_size=120))
def test_bit_vectors_equal_the_table(item, text):
    assert decontam.least_distance(item, text) == sellers(item, text)


def found(x, y, k):
    """The least distance of an item and a text, None beyond the budget; without a budget, as words alone."""
    if k:
        return best if (best := sellers(x, y)) <= k else None
    edge = lambda c: r"(?<![^\W_])" if c.isalnum() else ""
    return 0 if re.search(edge(x[0]) + re.escape(x) + edge(x[-1]).replace("<", ""), y) else None


def brute(docs, items, rate):
    out = set()
    for d, t in docs:
        for i, x in items:
            x, y = decontam.normal(x), decontam.normal(t)
            k = int(rate * len(x))
            if x and y and (best := found(x, y, k)) is not None:
                out.add((d, i, best, k))
    return out


def test_matches_equal_brute_force(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(1, 7)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(2, 14)))) for i in range(15)] + [(50, None), (51, " "), (52, "ab")]
    docs = []
    for d in range(60):
        text = " ".join(word() for _ in range(rnd.randint(0, 40)))
        if d % 3 == 0:
            x = list(rnd.choice(items[:15])[1].upper())
            for _ in range(rnd.randint(0, 5)):
                x[rnd.randrange(len(x))] = rnd.choice(["", "z", "qq", "\n"])
            text += "\n" + "".join(x) + "  tail"
        docs.append((d, text))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (103, "x " * 20_000 + items[1][1])]
    a = spark.createDataFrame([(d, t, "u") for d, t in docs], "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = brute(docs[:-1], items, 0.1) | {(103, 1, 0, int(0.1 * len(items[1][1])))}
    want |= {(103, i, best, k) for i, t in items[:15] + [(52, "ab")] if i != 1 and (best := found(decontam.normal(t), "x x x x " + items[1][1], k := int(0.1 * len(t)))) is not None}
    for block in (5000, 4):
        assert {tuple(r) for r in decontam.matches(a, b, 0.1, block).collect()} == want
    left = decontam.without_matches(a, b, rate=0.1)
    assert left.columns == a.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in docs if d not in {w[0] for w in want})
    assert decontam.matches(a.limit(0), b).count() == 0
    assert decontam.matches(a, b.limit(0)).count() == 0


def test_rows_of_one_doc_id_are_judged_each(spark):
    item = "which river runs through the old town of the two bridges"
    rows = [(None, f"so {item} then", 1), (None, "nothing of it", 2), (4, item, 3), (4, "clean words here", 4), (5, None, 5)]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontam.without_matches(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(2), items)
    assert sorted((tuple(r) for r in left.collect()), key=lambda r: r[2]) == [rows[1], rows[3], rows[4]]


def test_short_items_are_words(spark):
    docs = [(1, "the party was nice"), (2, "an ART of its own"), (3, "state-of-the-art"), (4, "depart"), (5, "c++ and more"), (6, "xc++"), (7, "artful art"), (8, "state of the art.")]
    items = spark.createDataFrame([(1, "art"), (2, "C++"), (3, "of the")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(2, 1), (3, 1), (7, 1), (8, 1), (5, 2), (8, 3)}
