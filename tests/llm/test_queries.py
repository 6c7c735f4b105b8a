"""Every query of the subpackage runs on the smallest tables and gives the columns it is to give."""

import pytest

from foliospark.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, same

COLUMNS = {
    "p1_found": ["field_name", "book_id", "k1", "k2", "k3"],
    "p2_found": ["field_name", "book_id", "page", "block_seq", "term_id"],
    "p3_found": ["field_name", "book_id", "block_id"],
    "p4_found": ["field_name", "book_id", "block_id", "fault"],
    "p5_found": ["field_name", "book_id", "block_id"],
    "p7_ids": ["doc_id", "ids"],
    "p9_found": ["doc_a", "doc_b"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.count() > 0 and df.columns == COLUMNS.get(name, df.columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, data, name):
    same(QUERIES[name](spark, data), connect(data), ORACLES[name])
