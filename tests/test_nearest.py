"""Searches over blocks of vectors against a plain loop: several blocks, rounded ties, groups, nulls, and no row per pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strataq.operators import metrics, nearest, retrieval

N = 240


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vectors = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(N)]
    for i in range(0, N, 4):
        # Copies, and copies that differ by less than a rounded score does.
        vectors[i] = [x + (1e-9 if i % 8 else 0.0) for x in vectors[1]]
    return [(i, v, i % 5) for i, v in enumerate(vectors)]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(nearest, "BASE_NUMBERS", 6 * 50)
    monkeypatch.setattr(nearest, "QUERY_NUMBERS", 6 * 4)
    monkeypatch.setattr(nearest, "AT_ONCE", 3)


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def best(rows, query, k, fits=lambda q, d: True, least=-2.0):
    q = rows[query]
    scored = [(round(cosine(q[1], d[1]), 6), d[0]) for d in rows if d[0] != query and fits(q, d)]
    return [(query, i, s) for s, i in sorted((x for x in scored if x[0] >= least), key=lambda x: (-x[0], x[1]))[:k]]


def sides(spark, rows):
    base = spark.createDataFrame(rows, "id long, vec array<double>, label long")
    return base.where("id % 20 = 0").withColumnRenamed("id", "query"), base


def got(df):
    return sorted((r["query"], r["place"], r["id"], round(r["score"], 6)) for r in df.collect())


def want(rows, *args, **more):
    return sorted((q, n + 1, i, s) for query in range(0, N, 20) for n, (q, i, s) in enumerate(best(rows, query, *args, **more)))


def test_best_by_rounded_scores_over_blocks(spark, rows, small_blocks):
    q, base = sides(spark, rows)
    assert got(retrieval.knn(q, base, 7, places=6)) == want(rows, 7)
    assert got(retrieval.knn(q, base, 300, places=6)) == want(rows, 300)
    assert got(retrieval.knn(q, base, 7, 0.4, "label", 6)) == want(rows, 7, lambda a, b: a[2] == b[2], 0.4)


def test_best_per_group(spark, rows, small_blocks):
    q, base = sides(spark, rows)
    hits = nearest.near_pairs(q, base, 3, places=6, by="label").collect()
    for label in range(5):
        mine = {}
        for r in hits:
            if r["label"] == label:
                mine.setdefault(r["query"], []).append((-r["score"], r["id"]))
        for query in range(0, N, 20):
            assert [(i, round(-s, 6)) for s, i in sorted(mine[query])[:3]] == [(i, s) for _, i, s in best(rows, query, 3, lambda a, b: b[2] == label)]


def test_gate_counts_pairs_that_are_no_rows(spark, rows, small_blocks):
    q, base = sides(spark, rows)
    counts = {r["query"]: (r["n"], r["kept"]) for r in retrieval.vector_gate(q, base, 0.59, 12, 6).collect()}
    assert counts == {i: (N - 1, len(best(rows, i, 12, least=0.59))) for i in range(0, N, 20)}
    same = {r["query"]: (r["n"], r["kept"]) for r in retrieval.gate(retrieval.vector_scores(q, base, places=6)).collect()}
    assert same == counts


def test_null_and_zero_vectors(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [-1.0, 0.0]), (None, [1.0, 0.0])], "id long, vec array<double>")
    q = base.where("id < 3").withColumnRenamed("id", "query")
    rows = {(r["query"], r["place"]): (r["id"], r["score"]) for r in retrieval.knn(q, base, 9).collect()}
    assert rows == {(1, 1): (3, 0.0), (1, 2): (4, -1.0), (1, 3): (2, None), (2, 1): (1, None), (2, 2): (3, None), (2, 3): (4, None)}
    assert retrieval.knn(q, base.limit(0), 3).collect() == [] and retrieval.knn(q.limit(0), base, 3).collect() == []


def test_ids_may_be_strings(spark, rows):
    q, base = sides(spark, rows)
    text = lambda df, c: df.withColumn(c, F.format_string("v%03d", c))
    found = retrieval.knn(text(q, "query"), text(base, "id"), 7, places=6).collect()
    assert sorted((int(r["query"][1:]), r["place"], int(r["id"][1:]), round(r["score"], 6)) for r in found) == want(rows, 7)


def test_no_pair_is_a_row(spark, rows):
    q, base = sides(spark, rows)
    plan = retrieval.vector_gate(q, base)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "query#" not in "".join(x for x in plan.splitlines() if "Join Cross" in x)


def test_metrics_by_label_are_those_of_listed_items(spark, rows):
    q, base = sides(spark, rows)
    ranked = retrieval.knn(q, base, 20, places=6)
    relevant = base.join(q.select("query", F.col("label").alias("l")), F.col("label") == F.col("l")).where("id <> query").select("query", "id")
    a = metrics.rank_metrics(ranked, relevant, 10)
    b = metrics.rank_metrics_by_label(ranked.select("query", "id", "place"), q.select("query", "label"), base.select("id", "label"), 10)
    plain = lambda df: sorted((r["query"], *(round(r[c], 9) for c in ("recall", "mrr", "ndcg"))) for r in df.collect())
    assert plain(a) == plain(b)
