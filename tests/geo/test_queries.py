import pytest
from compare import SF, available, same

import __spark_entry__ as entry
from geolith import more_queries, queries  # noqa: F401

pytestmark = pytest.mark.skipif(not available(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_entry(spark):
    assert {r.kind for r in entry.entry(spark).collect()} == {"row", "total"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert SF.startswith("/root/testdata")
