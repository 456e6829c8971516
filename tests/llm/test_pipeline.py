"""The pipeline against a brute-force version of its five stages, each of which is plain Python over all rows."""

import random
import statistics

import pytest

import corpus_pipeline
from tests.llm import test_mixing, test_neardup, test_quality
from tidestream.llm import decontam, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, key string, size long, __salt int"
ITEM = "which river runs through the old town of the two bridges and where does it meet the sea"


def good(rows):
    """Rows that neither fail by themselves nor stand on a host of which a shrunk failure rate is above the limit."""
    facts = []
    for r in rows:
        n, chars, symbols, dups, repeats, failed = test_quality.brute(r["text"])
        lines = sum(1 for x in (r["text"] or "").split("\n") if test_quality.WORD.search(x))
        facts.append({"short": n < 10, "repeats": 100 * repeats > 20 * n, "symbols": 10 * symbols > 3 * chars, "lines": lines > 3 and 2 * dups > lines, "failed": failed})
    hosts = {r["source"] for r in rows}
    count = {h: sum(r["source"] == h for r in rows) for h in hosts}
    worst = dict.fromkeys(hosts, 0.0)
    for rule in ("short", "repeats", "symbols", "lines"):
        bad = {h: sum(f[rule] for r, f in zip(rows, facts, strict=True) if r["source"] == h) for h in hosts}
        rates = [bad[h] / count[h] for h in hosts]
        m, v = statistics.fmean(rates), statistics.variance(rates) if len(rates) > 1 else 0
        strength = min(max(m * (1 - m) / v - 1, quality.PRIOR_LEAST), quality.PRIOR_MOST) if v > 0 else quality.PRIOR
        for h in hosts:
            worst[h] = max(worst[h], (bad[h] + m * strength) / (count[h] + strength))
    return [r for r, f in zip(rows, facts, strict=True) if not f["failed"] and worst[r["source"]] <= quality.HOST_LIMIT]


def one_of_each(rows):
    known = [(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None]
    kept = {x[0] for x in test_neardup.brute_repeated(known, size=5) if x[3]}
    return [r for r in rows if r["doc_id"] is None or r["doc_id"] in kept]


def without_repeats(rows):
    least = {}
    words = [test_quality.WORD.findall(r["text"] or "") for r in rows]
    for r, w in zip(rows, words, strict=True):
        for i in range(len(w) - 12):
            if r["doc_id"] is not None:
                k = tuple(w[i : i + 13])
                least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - 12) if r["doc_id"] is not None and least[tuple(w[i : i + 13])] < r["doc_id"] for j in range(i, i + 13)}
        text = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r["text"]
        if text or not gone:
            out.append(r | {"text": text, "n_chars": None if text is None else len(text)})
    return out


def clean(rows, items):
    held = [(x, int(decontam.RATE * len(x))) for _, t in items if (x := decontam.normal(t))]
    return [r for r in rows if not any(decontam.least_distance(x, decontam.normal(r["text"])) <= k for x, k in held if r["text"])]


def documents():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, notice = prose(60), prose(14)
    texts = [prose(rnd.randint(12, 80)) for _ in range(60)]
    for k in range(12):  # near copies, some of them of copies
        w = texts[k % 5].split()
        w[rnd.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [texts[7]] * 4 + [texts[8].upper()]
    texts += [f"{prose(20)} {passage} {prose(15)}" for _ in range(4)] + [f"{prose(30)}\n{notice}\n{prose(5)}" for _ in range(5)] + [passage, notice, prose(25) + " " + notice[:-3]]
    texts += [f"{prose(20)} {ITEM.upper()} {prose(9)}", prose(20) + " " + ITEM.replace("river", "rivr"), prose(20) + " " + ITEM[: len(ITEM) // 2]]
    texts += [None, "", " \n\t", "too short", "spam spam " * 40, "# | " * 30, "$$$ %%% " * 9 + prose(12), "same line of a few words here\n" * 9 + prose(60), prose(20_000)]
    rows = [(i * 7 % 1009, t, "en", f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(2000 + i, prose(30) if i % 9 == 0 else "bad one", "en", "poor") for i in range(60)]
    rows += [(3000, texts[20], None, None), (3001, prose(30), None, None), (None, texts[3], "en", "s1"), (None, prose(40), "en", None), (None, "short", "en", None), (None, f"{prose(20)} {ITEM}", "en", "s0")]
    rows += [rows[11], rows[11], (rows[12][0], prose(33), "de", "s2"), (rows[13][0], "short", "de", "s2")]  # repeated rows and ids
    rnd.shuffle(rows)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return [dict(zip(names, (d, t, lang, source, None if t is None else len(t), "h", "k", 3, i), strict=True)) for i, (d, t, lang, source) in enumerate(rows)]


ITEMS = [(1, ITEM), (2, None), (3, " \n"), (4, "a question that stands nowhere in these documents at all")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([tuple(r.values()) for r in documents()], SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_equals_brute_force(spark, folder):
    rows = documents()
    stages = []
    for step in (good, one_of_each, without_repeats, lambda x: clean(x, ITEMS)):
        rows = step(rows)
        stages.append(len(rows))
    assert len(documents()) > stages[0] > stages[1] > stages[2] > stages[3] > 0  # each one does something
    want = test_mixing.brute([(r["doc_id"], r["source"], r["text"]) for r in rows])
    got = sorted((tuple(r)[:5] for r in corpus_pipeline.run(spark, folder).collect()), key=str)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and g[4] == w[4] and g[3] == pytest.approx(w[3])


def test_stages_keep_rows_and_columns_as_they_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = {"quality rules": good, "minhash near-dedup": one_of_each, "substring dedup": without_repeats, "benchmark decontamination": lambda x: clean(x, ITEMS)}
    assert [name for name, _ in corpus_pipeline.STAGES] == [*steps, "mixing sources"]
    for name, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, docs.limit(0), folder)
        assert nothing.count() == 0
        if name in steps:  # each on the whole input, nulls and blank texts included
            found = stage(spark, docs, folder)
            assert found.columns == nothing.columns == docs.columns
            assert sorted((tuple(r) for r in found.collect()), key=str) == sorted((tuple(r.values()) for r in steps[name](documents())), key=str), name


def test_a_result_is_left_and_what_led_to_it_is_not(spark, folder):
    result = corpus_pipeline.run(spark, folder)
    (path,) = {x.rsplit("/", 2)[0] for x in result.inputFiles()}
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    assert {r.path.rsplit("/", 2)[1] for r in found.collect()} == {str(len(corpus_pipeline.STAGES) - 1)}
