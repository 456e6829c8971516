"""The operators' queries: those with SQL against DuckDB, the others against brute force, over the smallest tables."""

from pathlib import Path

import duckdb
import public_tokenizers
import pytest

from tests.llm import test_licences
from tidestream.llm import decontam, queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    found = queries.QUERIES[name](spark, str(DATA))
    names = sorted(found.columns)
    got = sorted(map(str, map(tuple, found.select(names).collect())))
    want = duck.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLES[name]})").fetchall()
    assert got and len(found.columns) == len(duck.execute(f"DESCRIBE {queries.ORACLES[name]}").fetchall())
    assert got == sorted(map(str, want))


def test_chat_query_holds_the_hard_conversation(spark):
    (row,) = queries.chat_formatting(spark, str(DATA)).filter("conv_id = -7").collect()
    assert (row.n_turns, row.loss_chars) == (2, len("</s>[INST] ok [/INST]"))


def test_token_counts_are_the_library_s(spark, duck):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, text in duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        n = len(library.encode(text, add_special_tokens=False).ids)
        want.append((d, len(text.encode()), n, n > 2048))
    assert sorted(map(tuple, queries.token_counts(spark, str(DATA)).collect())) == sorted(want)


def test_decontamination_is_that_of_all_stretches(spark, duck):
    docs, items = (duck.execute(f"SELECT {i}, text FROM {t}").fetchall() for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = sorted(map(tuple, queries.decontaminate(spark, str(DATA)).collect()))
    want = []
    for d, text in docs:
        for i, item in items:
            x = decontam.normal(item)
            if (best := decontam.least_distance(x, decontam.normal(text))) <= (k := int(decontam.RATE * len(x))):
                want.append((d, i, best, k))
    assert got and got == sorted(want)


def test_licences_are_those_of_brute_force(spark, duck):
    files = duck.execute("SELECT doc_id, '/' || source || '/' || lang || '/' || doc_id, text FROM documents").fetchall()
    got = [(r.doc_id, r.path, r.own_licence, r.licence, r.source_path) for r in queries.licence_scans(spark, str(DATA)).collect()]
    assert sorted(got, key=str) == test_licences.brute(files) and any(x[2] for x in got)
