"""The operators' queries against their SQL."""

import pytest

from caseloom.llm import queries

from ..test_queries import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    compare(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_has_a_row_per_document(spark, sf_dir, name):
    ids = [r["doc_id"] for r in queries.QUERIES[name](spark, sf_dir).select("doc_id").collect()]
    every = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    # Packing has a row for each piece, and the pipeline drops documents.
    assert set(ids) == every if name != "pipeline" else set(ids) < every
    assert len(ids) == len(every) or name in ("op7_best_fit_packing", "pipeline")
