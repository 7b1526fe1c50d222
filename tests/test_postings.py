"""The stored inverted index: rows of a full scan, fewer postings, and segments that come later."""

import random

import pytest
from pyspark.sql import functions as F

from strataq.operators import postings
from strataq.operators import retrieval as R


def texts(spark, seed, ids):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, rng.choices(words, weights, k=rng.choice([3, 10, 40, 150]))) for i in ids] + [(ids[-1] + 1, []), (ids[-1] + 2, None)]
    return spark.createDataFrame(rows, "id long, words array<string>")


def queries(spark):
    return spark.createDataFrame([(1, ["w0", "w50", "w50", "none"]), (2, ["w200", "w250"]), (3, ["w1", "w2", "w3", "w120"]), (4, ["missing"]), (5, [])], "query int, tokens array<string>")


def held(df):
    return sorted(tuple(r) for r in df.select("query", "id", "score", "place").collect())


def exact(spark, docs, k):
    docs = docs.withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    return held(R.top_k(R.bm25(queries(spark), docs).withColumn("score", F.round("score", 6)), k))


def test_rows_of_a_full_scan_with_fewer_postings(spark, tmp_path):
    a, b = texts(spark, 1, range(0, 900)), texts(spark, 2, range(1000, 1500))
    index = postings.InvertedIndex(spark, f"file://{tmp_path}/index")
    one = index.append(a)
    for k in (1, 5, 2000):
        assert held(index.search(queries(spark), k)) == exact(spark, a, k)
    index.append(b)
    both = a.unionByName(b)
    for k in (1, 7):
        assert held(index.search(queries(spark), k)) == exact(spark, both, k)
    # A reader of the first version sees its texts, numbers and frequencies only.
    assert held(index.search(queries(spark), 5, version=one)) == exact(spark, a, 5)
    read, of = index.postings_read(queries(spark), 5)
    assert of == both.select(F.explode("words").alias("token"), "id").distinct().join(queries(spark).select(F.explode(F.array_distinct("tokens")).alias("token")), "token").count()
    assert 0 < read < 0.6 * of, (read, of)


def test_tokens_beyond_the_list_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "LISTED", 2)
    docs = texts(spark, 3, range(200))
    index = postings.InvertedIndex(spark, f"file://{tmp_path}/index")
    index.append(docs)
    assert held(index.search(queries(spark), 4)) == exact(spark, docs, 4)


def test_an_empty_index(spark, tmp_path):
    index = postings.InvertedIndex(spark, f"file://{tmp_path}/index")
    assert index.search(queries(spark), 3).collect() == []
    index.append(texts(spark, 3, range(2)).limit(0))
    assert index.search(queries(spark), 3).collect() == []


def test_words_are_counted_where_they_lie(spark, tmp_path):
    """No words are shuffled to be counted, one token is in a range once, and ranges go on from batch to batch."""
    docs = texts(spark, 5, range(0, 700)).unionByName(spark.createDataFrame([(2000, ["w1", None, "w1"])], "id long, words array<string>"))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    made, append = [], postings.VersionedTable.append
    try:
        with pytest.MonkeyPatch.context() as m:
            m.setattr(postings, "AT_ONCE", 500)
            m.setattr(postings.VersionedTable, "append", lambda self, rows: (made.append(rows), append(self, rows))[1])
            index = postings.InvertedIndex(spark, f"file://{tmp_path}/index")
            index.append(docs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate(keys=[token" not in plan
    rows = index.table.read().where("token <> ''").collect()
    assert len(rows) == len({(r["token"], r["range"]) for r in rows})
    assert max(r["n"] for r in rows) <= postings.RANGE and all(r["n"] == len(r["texts"]) and [x["id"] for x in r["texts"]] == sorted(x["id"] for x in r["texts"]) for r in rows)
    want = docs.select("id", F.size("words").alias("length"), F.explode("words").alias("token")).where("token IS NOT NULL").groupBy("token", "id", "length").count().collect()
    assert sorted((r["token"], x["id"], x["length"], x["tf"]) for r in rows for x in r["texts"]) == sorted((r["token"], r["id"], r["length"], r["count"]) for r in want)
    assert held(index.search(queries(spark), 6)) == exact(spark, docs, 6)
