"""Stages give other columns back with their values, whatever they are called."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

NAMES = ["n_lines", "n_removed", "_ln_gone", "_ln_row", "_at_path", "_at_row", "_mix_size", "_mix_row", "_hit_text", "_hot", "_salt", "Rest", "other_columns", "h1", "line", "a.b", "c`d", "score", "rep"]


@pytest.mark.parametrize("stage", range(5))
@pytest.mark.parametrize("written", [True, False])
def test_values_of_other_columns_stay(spark, tmp_path, stage, written):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("doc_id") < 120)
    base = 1000 * F.col("doc_id")
    quoted = lambda n: F.col("`" + n.replace("`", "``") + "`")
    docs = d.select("*", *[(base + i).alias(n) for i, n in enumerate(NAMES)])
    if written:
        plain = [n for n in NAMES]
        docs.write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs")).select(*d.columns, *[quoted(n) for n in plain])
    name, f = cp.STAGES[stage]
    got = f(spark, docs, "/root/testdata/sf0.001")
    assert got.columns[: len(docs.columns)] == docs.columns
    rows = got.collect()
    assert rows and all(r[n] == 1000 * r["doc_id"] + i for r in rows for i, n in enumerate(NAMES))
    without = f(spark, d, "/root/testdata/sf0.001").select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in without)
