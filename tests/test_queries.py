"""Every query with SQL of its own gives DuckDB's rows; the rest of the repository stands without the llm folders."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tidestream.plans import queries as core

REPO = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(str, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    got = rows(core.QUERIES[name](spark, str(DATA)).toPandas())
    assert got[1]
    if name in core.ORACLES:
        assert got == rows(duck.execute(core.ORACLES[name]).df())


def test_core_imports_nothing_of_llm():
    for p in (REPO / "tidestream").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "tidestream.llm" not in p.read_text() and "import llm" not in p.read_text(), p


def test_entry_stands_without_llm(tmp_path):
    for name in ("__spark_entry__.py", "tidestream"):
        os.symlink(REPO / name, tmp_path / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    for p in (REPO / "tidestream").iterdir():
        if p.name not in ("llm", "__pycache__"):
            os.symlink(p, tmp_path / "tidestream" / p.name)
    code = "import sys; sys.path[0] = '.'; import importlib.util as u; s = u.spec_from_file_location('e', '__spark_entry__.py'); m = u.module_from_spec(s); s.loader.exec_module(m); print(len(m.queries()), [k for k in m.queries() if k[:2] == 'op' or k == 'pipeline'])"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert out.stdout.strip().endswith(f"{len(core.QUERIES)} []"), out.stderr[-800:]
