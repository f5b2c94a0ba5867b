"""The numbered queries that SQL expresses, against it; and the shapes of all."""

import pytest

from stowage.llm import oracles, queries

from ..oracle import assert_equal, database

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query(spark, name):
    assert_equal(queries.QUERIES[name](spark, SF), database(SF), oracles.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.ORACLES)))
def test_covers_the_table(spark, name):
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in queries.QUERIES[name](spark, SF).select("doc_id").collect()} == docs
