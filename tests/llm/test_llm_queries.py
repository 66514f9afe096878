"""The queries of this subpackage on the smallest tables, against SQL where there is some."""

import pytest
from oracle import both, connect

from quirefold.llm.queries import QUERIES, SQL

COLUMNS = {
    "p1_found": ["row_id"],
    "p2_found": ["entry_id", "field_name"],
    "p3_found": ["row_a", "row_b"],
    "p6_found": ["row_id", "field_name"],
    "p7_found": ["doc_id", "item_id"],
    "p9_found": ["doc_id", "subject"],
}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    if name in SQL:
        ours, theirs = both(spark, con, small, QUERIES[name], SQL[name])
        assert ours == theirs
    else:
        rows = QUERIES[name](spark, small)
        assert rows.columns == COLUMNS.get(name, rows.columns) and rows.count() >= 0
