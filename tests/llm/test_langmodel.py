import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidestream.llm import langmodel as L


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), ""]


def brute(rows):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score."""
    counts = collections.Counter(t for d, text, *_ in rows if not held(d) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    base = lambda t: math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1)))
    return [(d, held(d), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), total, pytest.approx(sum(map(base, tokens(t))))) for d, t, *_ in rows]


def corpus(n=400):
    """Texts of two kinds, each of its own words, in which some words follow others."""
    rnd, out = random.Random(4), []
    for i in range(n):
        kind = rnd.choice("xy")
        words = [f"{kind}{rnd.randint(0, 30)}"]
        while len(words) < 60:
            words.append(f"{kind}{int(words[-1][1:]) // 2}" if rnd.random() < 0.5 else f"{kind.upper()}{rnd.randint(0, 30)}" if rnd.random() < 0.9 else f"r{rnd.randint(0, 3000)}")
        out.append((i, " ".join(words), 0))
    return out


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_base_scores_are_those_of_brute_force_and_the_model_does_better_on_held_out_texts(spark):
    rows = [*corpus(), (None, "x1 Ünseen É", 0), (401, None, 0), (402, " \n", 0), (403, "x1 x2", 0), (403, "X1 x2", 0), (404, "a" * 100_000, 0), (405, "y3 " * 50_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3)
    got = rows_of(L.scored(docs, classes=64, width=8, chunk_words=4000))
    assert sorted((g[:6] for g in got), key=str) == sorted(brute(rows), key=lambda r: str((*r[:5], r[5].expected)))
    out = [g for g in got if g[1] and g[2] == 61]
    assert len(out) > 40 and sum(g[6] for g in out) > sum(g[5] for g in out) + 0.2 * 61 * len(out)


def test_chunks_do_not_matter_to_counts(spark):
    docs = spark.createDataFrame(corpus(60), "doc_id long, text string, n int")
    few, many = (rows_of(L.scored(docs.repartition(k), classes=16, width=4, chunk_words=w)) for k, w in ((1, 1 << 20), (4, 100)))
    assert [g[:5] for g in few] == [g[:5] for g in many] and [g[5] for g in few] == pytest.approx([g[5] for g in many])


def test_no_documents_and_none_to_train_on(spark):
    schema = "doc_id long, text string"
    assert L.scored(spark.createDataFrame([], schema)).collect() == []
    out = [i for i in range(50) if held(i)]
    got = L.scored(spark.createDataFrame([(i, "a b") for i in out], schema)).collect()
    assert {(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(True, 3, 0, 0)}
    assert {r.base_score for r in got} == {0.0} and all(r.score <= 0 for r in got)


def test_probabilities_of_all_tokens_sum_to_one_whatever_came_before():
    rnd = np.random.default_rng(1)
    counts = np.array([40, 30, 20, 10, 5])
    model = L.initial([b"", b"a", b"b", b"c"], counts, 6)
    trainer = L.Trainer(model, 8, 0.2, 1)
    trainer.learn(rnd.integers(0, 5, 2000), rnd.integers(0, 5, 2000), rnd.integers(0, 5, 2000), 64)
    model = L.Model(model.tokens, counts, trainer.w)
    for before in range(5):
        for last in range(5):
            log = model.scores(np.full(5, before), np.full(5, last), np.arange(5), block=3)
            assert np.exp(log).sum() == pytest.approx(1, abs=1e-5)
    rare = {"p": 25, "q": 15}  # what shares a class, and the unknown: 40 occurrences, two tokens
    assert sum(c + 0.5 for c in [*rare.values(), 0]) == pytest.approx(40 + 0.5 * 3)


def test_contexts_end_with_documents():
    line, ends = np.array([5, 6, 7, 1, 1, 8, 1]), np.array([4, 5, 7])
    before, last = L.contexts(line, ends)
    assert last.tolist() == [1, 5, 6, 7, 1, 1, 8] and before.tolist() == [1, 1, 5, 6, 1, 1, 1]
