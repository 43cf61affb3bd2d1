"""Queries of the training-data operators on the smallest tables: against DuckDB where SQL can say it, and the pipeline."""

import re

import pytest

import corpus_pipeline
from newsdesk.llm.queries import ORACLES, QUERIES
from tests.compare import connect, same_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same_rows(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_a_row_for_every_input(spark, name):
    out = QUERIES[name](spark, FOLDER)
    key, table = ("page_id", "pages") if "page_id" in out.columns else ("doc_id", "documents")
    want = {r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in out.select(key).collect()} == want


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, FOLDER).cache()
        assert kept.columns == docs.columns, name
        assert 0 < kept.count() <= before.count(), name
    rows = kept.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    assert all(r.n_chars == len(r.text) for r in rows)
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text) for r in rows)
    pieces = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in rows}
