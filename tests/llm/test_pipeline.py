"""The pipeline and the registered queries over the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from graphloom.llm import queries, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


def test_stages_keep_the_columns_and_only_drop_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.schema
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in columns], name
        out = spark.createDataFrame(out.collect(), columns)
        if name != "mix":
            assert out.join(docs, "doc_id", "left_anti").count() == 0
            assert out.count() <= docs.count()
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_near_duplicates_leave_one_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    groups = simhash.similar_documents(docs).select("component_id").distinct().count()
    assert kept.count() == groups
    twice = docs.unionAll(docs.withColumn("doc_id", docs["doc_id"] + 1_000_000))
    assert corpus_pipeline.drop_near_duplicates(spark, twice, SF).count() == groups


def test_stages_on_awkward_tables(spark):
    rows = [(0, None, "en", "a", 0), (1, "", None, None, 0), (2, "same line here\n" * 3, "en", "a", 45), (3, "same line here", "en", "b", 14), (None, "no id at all", "en", "b", 12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    lines = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    assert lines == {0: (None, 0), 1: ("", 0), 2: ("same line here\n", 15), None: ("no id at all", 12)}
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).collect()
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_keep_columns_with_awkward_names(spark):
    rows = [(i % 3 or None, f"some words that differ {i} times\nand a line of their own {i}" if i < 8 else "the same text here", "en", "ab"[i % 2], 0, f"own {i}", 2, 3, "d", "r") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, n_kept int, n_lines int, d string, `row` string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names, name
        for r in out.collect():
            assert (r["n_kept"], r["n_lines"], r["d"], r["row"]) == (2, 3, "d", "r") and r["a.b"].startswith("own"), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 12
    left = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sum(r.text == "the same text here" for r in left) == 1


def test_queries_are_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert len([k for k in names if k.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
