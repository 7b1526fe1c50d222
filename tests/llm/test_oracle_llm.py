"""The operators that SQL can express give DuckDB's rows on the smallest tables."""

import pytest

from strataq.llm import registry
from tests_support import SF, rows_of


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    order = sorted(cols)
    assert sorted(df.columns) == order
    assert rows_of(df.select(*order).collect()) == rows_of([[r[cols.index(c)] for c in order] for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_return_a_row_per_document(spark, name):
    assert registry.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
