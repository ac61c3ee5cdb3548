"""The subpackage's queries against their SQL on the smallest tables; recall of the vector search on whole tables."""

import os

import pytest

from scholark.llm import queries
from scholark.llm.neighbours import recall_of
from scholark.sources.tables import table
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLES:
        assert compare(df, duck, queries.ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_recall(spark):
    assert recall_of(table(spark, "/root/testdata/sf0.01", "persona_embeddings"), "persona_id", "task_embedding", 5, 64, leaf_rows=32) >= 0.9
    assert recall_of(table(spark, "/root/testdata/sf0.01", "persona_embeddings"), "persona_id", "method_embedding", 5, 64, sample_rows=64, leaf_rows=16, deeper=1, inner_leaves=16) >= 0.9
