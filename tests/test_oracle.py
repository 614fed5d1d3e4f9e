"""Every registered query beside its oracle SQL."""

import pytest
from compare import duck, run_pair

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    rows, problem = run_pair(spark, con, name, QUERIES, ORACLES, sf)
    assert problem in (None, "rows only"), problem


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["query_id", "document_chunk_id", "document_id", "similarity_score", "rank"]
    assert df.count() == 400
