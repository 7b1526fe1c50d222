"""The stored vector index: codes, recall against all vectors, and batches that come later."""

import numpy as np

from strataq.operators import cells
from strataq.operators import retrieval as R
from strataq.queries import registry
from strataq.plans import tables as T
from tests_support import SF


def vectors(spark, seed, ids, dims=16, groups=12):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(groups, dims))
    rows = [(int(i), [float(x) for x in centres[rng.integers(groups)] + 0.4 * rng.normal(size=dims)]) for i in ids]
    return spark.createDataFrame(rows, "id long, vec array<double>")


def pairs(df):
    return {(r["query"], r["id"]) for r in df.collect()}


def test_codes_are_near_what_they_stand_for():
    u = np.random.default_rng(1).normal(size=(500, 8)).astype(np.float32)
    low, high = np.quantile(u, 0.005, axis=0), np.quantile(u, 0.995, axis=0)
    back = cells.decoded(cells.encoded(u, low, high), low, high)
    inside = (u >= low) & (u <= high)
    assert np.abs(back - u)[inside].max() <= ((high - low) / 510).max() + 1e-6
    assert (back >= low - 1e-5).all() and (back <= high + 1e-5).all()


def test_recall_grows_with_probes_and_is_whole_with_all(spark, tmp_path):
    base = vectors(spark, 2, range(1500))
    extra = spark.createDataFrame([(5000, [0.0] * 16), (5001, None)], "id long, vec array<double>")
    index = cells.VectorIndex(spark, f"file://{tmp_path}/index", cells=24)
    index.append(base.where("id < 900").unionByName(extra))
    index.append(base.where("id >= 900"))
    queries = base.where("id % 50 = 0").withColumnRenamed("id", "query")
    want = pairs(R.knn(queries, base, 10))
    recall = [len(want & pairs(index.search(queries, 10, probes))) / len(want) for probes in (1, 6, 24)]
    assert recall[0] <= recall[1] <= recall[2] and recall[1] >= 0.9 and recall[2] >= 0.97
    got = index.search(queries, 10, 24)
    assert got.where("place > 10 OR query = id").count() == 0
    exact = {(r["query"], r["id"]): r["score"] for r in R.knn(queries, base, 10).collect()}
    assert all(abs(exact[r["query"], r["id"]] - r["score"]) < 1e-5 for r in got.collect() if (r["query"], r["id"]) in exact)
    again = cells.VectorIndex(spark, f"file://{tmp_path}/index")
    assert pairs(again.search(queries, 10, 24)) == pairs(got)


def test_nothing_is_found_in_an_empty_index(spark, tmp_path):
    index = cells.VectorIndex(spark, f"file://{tmp_path}/index")
    q = vectors(spark, 3, range(3)).withColumnRenamed("id", "query")
    index.append(vectors(spark, 3, range(3)).limit(0))
    assert index.search(q, 5, 4).collect() == []
    index.append(vectors(spark, 3, range(1)))
    assert pairs(index.search(q, 5, 4)) == {(1, 0), (2, 0)}


def test_registered_query_reaches_nine_tenths(spark):
    want = pairs(R.knn(T.vectors(spark, SF).where("vec_id % 50 = 0").selectExpr("vec_id AS query", "vec"), T.vectors(spark, SF).withColumnRenamed("vec_id", "id"), 10))
    assert len(want & pairs(registry.QUERIES["ann_topk"](spark, SF))) >= 0.9 * len(want)
