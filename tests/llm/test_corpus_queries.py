import pytest
from compare import SF, available, same

from geolith.llm import queries

pytestmark = pytest.mark.skipif(not available(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_gives_a_row_for_each(spark, name):
    table = "pages" if name.startswith("op1_") else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert queries.QUERIES[name](spark, SF).count() == (2 * n if name.startswith("op1_") else n)
