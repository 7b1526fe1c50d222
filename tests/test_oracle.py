"""Every query with SQL gives DuckDB's rows on the smallest tables."""


import pytest

from strataq.queries import registry
from tests_support import SF, rows_of

NAMES = sorted(registry.ORACLE_SQL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    assert rows_of(df.select(*order).collect()) == rows_of([[r[cols.index(c)] for c in order] for r in want.fetchall()])


def test_queries_without_sql_run(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)):
        registry.QUERIES[name](spark, SF).count()
