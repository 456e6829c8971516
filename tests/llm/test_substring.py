import hashlib
import random
import re

from tidestream.llm import substring

SCHEMA = "doc_id long, text string, bucket string, packed int"


def brute(rows, size):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            least[k] = min(least.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if least[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in substring.removed_digest(df, **kw).collect())


def test_matches_brute_force(spark):
    random.seed(5)
    vocab = [f"w{i}é" for i in range(60)] + ["a", "b"]
    passages = [" ".join(random.choices(vocab, k=random.randint(10, 40))) for _ in range(6)]
    rows = []
    for d in range(150):
        parts = [" ".join(random.choices(vocab, k=random.randint(0, 30))) for _ in range(3)]
        if random.random() < 0.5:
            parts.insert(1, random.choice(passages))
        rows.append((d * 7 % 150 - 3, random.choice([" ", "\n", "\t \n"]).join(parts)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "a " * 5000), (904, "a " * 4000), (905, passages[0]), (906, passages[0]), (-50, passages[1])]
    for chunk in (50, 1 << 20):
        assert run(spark, rows, chunk_words=chunk) == brute(rows, 13)
    assert run(spark, rows, window=2, chunk_words=300) == brute(rows, 2)


def test_repeated_ids_null_ids_and_empty_table(spark):
    text = " ".join(f"t{i}" for i in range(20))
    rows = [(1, text), (1, text), (2, text), (None, text)]
    got = [(r.doc_id, r.n_removed) for r in substring.removed_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == [(1, 0), (1, 0), (2, 20), (None, 0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert substring.removed_digest(empty).count() == 0
    assert substring.remove_repeats(empty).columns == ["doc_id", "text", "bucket", "packed"]


def test_rows_of_one_id_lose_what_their_own_text_repeats(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(13))
    other = " ".join(f"q{i}" for i in range(30))
    rows = [(1, passage), (2, passage + " a b c d e"), (2, other), (2, other), (3, other + " z"), (None, passage)]
    random.seed(3)
    more = [(random.randint(5, 9), " ".join(random.choices([passage, other, "x y", f"u{i}"], k=3))) for i in range(60)]
    for few in (substring.C.BROADCAST_ROWS, 0):
        monkeypatch.setattr(substring.C, "BROADCAST_ROWS", few)
        assert run(spark, rows[:-1] + more) == brute(rows[:-1] + more, 13)
        kept = substring.remove_repeats(spark.createDataFrame([(d, t, "n", {"k": 1}) for d, t in rows], "doc_id long, text string, __doc string, __ranges map<string,int>"))
        assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted([(1, passage), (2, "a b c d e"), (2, other), (2, other), (3, "z"), (None, passage)], key=str)
        assert kept.columns == ["doc_id", "text", "__doc", "__ranges"]


def test_a_chunk_sends_few_triples_whatever_the_partitions(spark):
    random.seed(1)
    often = "in the name of"
    texts = spark.createDataFrame([(" ".join([*(f"w{random.randint(0, 10**6)}" for _ in range(900)), often] * 3),) for _ in range(40)], "text string").coalesce(2)
    sent = texts.mapInArrow(lambda it: substring._sampled(it, 13, 50_000), "code long, n long, seen long, words long")
    chunks = sent.filter("words > 0").count()
    assert sent.count() <= (substring.SAMPLED + 1) * chunks and chunks <= 6
    assert sent.agg({"words": "sum"}).first()[0] == 40 * 3 * 904
    for partitions in (4, 100_000):
        substring.frequent(texts, 13, substring.BUCKETS_PER_PARTITION * partitions, 50_000)


def test_texts_lose_only_repeats(spark):
    text = " ".join(f"t{i}" for i in range(20))
    rows = [(1, text, "a", 0), (2, "own  words\n" + text, "b", 1), (3, text, "c", 2), (4, None, None, None), (5, "", "d", 3), (6, "keeps\n its  space", "e", 4)]
    got = {r.doc_id: tuple(r)[1:] for r in substring.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (text, "a", 0), 2: ("own words", "b", 1), 4: (None, None, None), 5: ("", "d", 3), 6: ("keeps\n its  space", "e", 4)}


def test_windows_around_frequent_words_are_spread(spark):
    rnd = random.Random(12)
    own = lambda n: " ".join(f"o{rnd.randrange(10**6)}" for _ in range(n))
    line = " ".join(f"f{i}" for i in range(20))
    rows = [(d, f"{own(12)} on behalf of {own(12)}") for d in range(300)] + [(500 + d, f"{own(14)} {line} {own(3)}") for d in range(30)]
    rows += [(900, rows[3][1] + " tail"), (901, "x " + rows[310][1])]
    for chunk in (60, 1 << 20):
        assert run(spark, rows, chunk_words=chunk) == brute(rows, 13)
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hot = substring.frequent(texts.select("text"), 13, 64, 1 << 20)
    assert 1 <= len(hot) <= 6 * 64

    def fullest(hot):
        n = {}
        for b in texts.selectExpr("*", "0L as twin").toArrow().to_batches():
            for bucket, _, _, packed in (x for out in substring._send([b], 13, 64, 1 << 20, hot) for x in zip(*(c.to_pylist() for c in out.columns), strict=True)):
                if bucket >= 0:
                    n[bucket] = n.get(bucket, 0) + int(substring._unpack(packed, 5)[0][3].sum())
        return max(n.values()) / sum(n.values())

    assert fullest(hot) < 0.05 < 0.1 < fullest(hot[:0])


def test_nothing_is_frequent_in_nothing(spark):
    assert len(substring.frequent(spark.createDataFrame([(None,), ("",), ("a b",)], "text string"), 13, 16, 100)) == 0
