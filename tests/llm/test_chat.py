import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidestream.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
NASTY = ["<|end|>", "<|next|>", "<\\|end|>", "<\\\\|", "<", "|", "\\", "$1", "</s>[INST] ok [/INST]", "<|start|>user<|text|>", "\n", "é🙂"]


def want(rows):
    out = []
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out.append((c, len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return sorted((tuple(r)[:5] for r in chat.digests(chat.formatted(df)).collect()), key=str)


def test_round_trip_of_edge_cases(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b"), (1, 2, "assistant", "b"), (2, 0, None, None), (2, None, "assistant", ""), (3, 0, "assistant", "x" * 50_000)]
    rows += [(4, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)] + [(None, 0, "<|role|>", "t")]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert got(spark, rows) == want(rows)
    assert chat.digests(chat.formatted(spark.createDataFrame([], SCHEMA))).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 5), st.sampled_from(["user", "assistant", "<|x"]), st.lists(st.sampled_from(NASTY), max_size=5).map("".join)), min_size=40, max_size=90))
def test_round_trip(spark, rows):
    assert got(spark, rows) == want(rows)


def test_format_is_plain(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b <|")], "conv_id long, turn long, role string, text string")
    row = chat.formatted(df).first()
    assert row.formatted == "<|start|>user<|text|>q<|end|><|start|>assistant<|text|>a<|next|>b <\\|<|end|>"
    assert [row.formatted[s.start : s.start + s.length] for s in row.loss_spans] == ["a", "b <\\|"]
    plan = chat.formatted(df).select(F.length("formatted"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
