"""Fixpoints run until nothing is left, however long a chain is."""

import inspect

import pytest

from strataq.operators import graph, pairs


def test_greedy_settles_a_chain_of_more_than_a_hundred(spark):
    n = 104
    items = spark.createDataFrame([(i,) for i in range(n)], "vec_id long")
    links = spark.createDataFrame([(i, i + 1, 0.9) for i in range(n - 1)], "a long, b long, similarity double")
    got = {r["vec_id"]: r["rep"] for r in pairs.greedy_representatives(items, links).collect()}
    assert got == {i: i - i % 2 for i in range(n)}


def test_greedy_raises_where_items_wait_for_each_other(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "vec_id long")
    with pytest.raises(RuntimeError):
        pairs.greedy_representatives(items, spark.createDataFrame([(1, 2), (2, 1)], "a long, b long"))


def test_closures_have_no_limit_of_their_own(spark):
    assert inspect.signature(graph.closure).parameters["max_hops"].default is None and "max_hops" not in inspect.signature(graph.widest_closure).parameters
    edges = spark.createDataFrame([(i, i + 1, 1 + i % 2) for i in range(8)], "src long, dst long, level int")
    seed = spark.createDataFrame([(0, 2)], "node long, level int")
    assert {tuple(r) for r in graph.closure(seed, edges).collect()} == {(i, i) for i in range(9)}
    assert {tuple(r) for r in graph.widest_closure(seed, edges).collect()} == {(0, 2)} | {(i, 1) for i in range(1, 9)}
