"""Texts are cut once for all lanes that rank by their tokens, and the lanes give what they gave."""

import pytest

from strataq.operators import retrieval as R
from tests_support import SF, rows_of


@pytest.mark.parametrize("name", ["judge_pools", "bm25_topk", "rrf_fusion"])
def test_no_lane_cuts_texts_again(spark, name):
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(lower(text" not in plan


def test_lanes_from_postings(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a", "x"]), (2, ["b"]), (3, []), (4, None), (5, ["a", "c", "host"])], "id long, words array<string>")
    queries = spark.createDataFrame([(7, ["a", "b", "q"]), (8, ["c"]), (9, []), (10, ["none"])], "query long, tokens array<string>")
    held = R.query_postings(queries, docs)
    assert sorted(tuple(r) for r in held.collect()) == [("a", 1, 4, 2), ("a", 5, 3, 1), ("b", 1, 4, 1), ("b", 2, 1, 1), ("c", 5, 3, 1)]
    assert rows_of(R.lexical_of(queries, held).collect()) == rows_of(R.lexical_scores(queries, docs.selectExpr("id", "array_distinct(words) AS tokens")).collect())
    assert rows_of(R.bm25_of(queries, held, docs).collect()) == rows_of(R.bm25(queries, docs).collect())
