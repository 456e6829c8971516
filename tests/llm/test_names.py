"""Stages of the pipeline leave columns alone, whatever they are called and whatever they hold."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidestream.llm import common

NAMES = "__row __doc __found __ranges __twin __several __t __l __n __c __h __s __p __key __salt_l row rest found twin host bucket doc ranges text_ __doc_id".split()


@pytest.mark.parametrize("rows_for_broadcast", [common.BROADCAST_ROWS, 0])
def test_stages_keep_columns_of_clashing_names(spark, tmp_path, monkeypatch, rows_for_broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows_for_broadcast)
    text = "the river runs through the old town under two bridges and then it meets the sea not far away"
    rows = [(k, f"{text} {k} " + " ".join(f"w{k}x{j}" for j in range(30)), "en", f"s{k % 2}", 1) for k in range(6)] + [(0, text + " and twice as many others than there were before", "en", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *(F.create_map(F.lit("k"), F.col("doc_id")).alias(n) for n in NAMES))
    spark.createDataFrame([(1, "an item that no document holds at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        assert got.count() >= 6 and {tuple(r[n].items()) for r in got.collect() for n in NAMES} <= {(("k", k),) for k in range(6)}, name
