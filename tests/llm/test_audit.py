import itertools
import random
import re

from tidestream.llm import audit


def fails(rows):
    """Of each row its failing filters, judged one by one."""
    out = []
    for doc_id, text, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [d for d, x, *_ in rows if (x or "") == t and d is not None]
        out.append({f for f, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search("[#$%&*|]", t), doc_id is not None and any(d < doc_id for d in same)), strict=True) if bad})
    return out


def brute(rows, labels):
    failed, out = fails(rows), {}
    for part in {r[2] or "" for r in rows}:
        own = [(f, {q for d, q, _ in labels if d == r[0] and d is not None}, {t for d, _, t in labels if d == r[0] and d is not None}) for r, f in zip(rows, failed, strict=True) if (r[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                removed = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                out[part, "".join(order), step] = [len(left), len(removed), sum(x in r[0] for r in own) - len(removed), sum(r[0] == {x} for r in own), sum(1 in r[1] for r in removed), sum(1 in r[2] for r in removed)]
    for (part, order, step), v in out.items():
        v.append(sum(u[1] for (p, o, s), u in out.items() if p == part and o[s - 1] == order[step - 1]))
    return {(*k, *v) for k, v in out.items()}


def test_audit_is_that_of_brute_force(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["Ab", "cd", "EF", "#x", "y"]) + str(rnd.randint(0, rnd.choice((50, 5000))))
    text = lambda: rnd.choice([" ", "\n", "  "]).join(word() for _ in range(rnd.choice((1, 99, 100, 101, 180))))
    rows = [(i, text(), rnd.choice(["en", "de", None, ""]), 0) for i in range(60)]
    rows += [(100 + i, rnd.choice(rows)[1], rnd.choice(["en", "de"]), 0) for i in range(30)]
    rows += [(None, rows[0][1], "en", 0), (None, None, "en", 0), (5, rows[7][1], "de", 0), (7, rows[7][1], "en", 0), (7, rows[7][1], "en", 0), (300, None, "en", 0), (301, "", None, 0), (302, "A" * 99 + " é", "xx", 0), (303, "w " * 200_000, "de", 0)]
    labels = [(r[0], rnd.choice([0, 1, None]), rnd.choice([0, 1])) for r in rows if rnd.random() < 0.6] + [(3, 1, 0), (3, 1, 1), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, mask int").repartition(5)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [(r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit.audited(docs, said).collect()]
    want = brute(rows, labels)
    assert len(got) == len(want) == 600 * 4
    assert set(got) == want


def test_no_documents_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    said = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audited(docs.limit(0), said).count() == 0
    rows = audit.audited(docs, said).collect()
    assert {(r.removed, r.shapley) for r in rows if r.filter_order[r.step - 1] == "A"} == {(1, 120)} and {r.good_lost for r in rows} == {0}
