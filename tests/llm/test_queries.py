import os

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from meterlens.llm.queries import QUERIES
from tests.oracle import compare, connect

FOLDER = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_all_are_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert {*QUERIES, *corpus_pipeline.QUERIES} <= set(queries())


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query_equals_sql(spark, name):
    assert compare(queries()[name](spark, FOLDER), connect(FOLDER), oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(
    n for n, q in QUERIES.items() if not q.sql and n != "op12_whitening"))
def test_query_has_a_row_per_document_or_piece(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = queries()[name](spark, FOLDER)
    assert got.select("doc_id").distinct().count() == docs.count()
