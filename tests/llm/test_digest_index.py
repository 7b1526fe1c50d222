"""The digest index over several batches and sessions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from strataq.llm import exact_dedup
from tests_support import SF, rows_of, together


def batch(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_an_index_keeps_its_number_of_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, path, 8)
    index.ingest(batch(spark, [(i, f"t{i}") for i in range(100)])).count()
    index.close()
    with pytest.raises(ValueError, match="8 buckets"):
        exact_dedup.DigestIndex(spark, path, 4)
    again = exact_dedup.DigestIndex(spark, path)
    assert again.buckets == 8 != int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = again.ingest(batch(spark, [(1000 + i, f"t{i}") for i in range(100)])).collect()
    assert len(got) == 100 and all(r["keep_id"] == r["doc_id"] - 1000 for r in got) and again.table().count() == 100
    small = again.compacted(f"file://{tmp_path}/compact")
    assert rows_of(small.table().collect()) == rows_of(again.table().collect())
    assert {r["keep_id"] for r in small.ingest(batch(spark, [(7000, "t3"), (7001, "new")])).collect()} == {3, 7001}
    assert len(list((tmp_path / "index").glob("_buckets-*"))) == 1
    again.close()
    small.close()


def test_a_folder_of_unknown_buckets_is_refused(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/plain")
    with pytest.raises(ValueError, match="buckets"):
        exact_dedup.DigestIndex(spark, f"file://{tmp_path}/plain")


def test_second_half_of_the_table_meets_the_first_in_the_index(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 3)
    index.ingest(docs.where("doc_id % 2 = 0")).count()
    got = exact_dedup.exact_duplicates(docs.where("doc_id % 2 = 1"), index).select("doc_id", "keep_id", "group_size", "kept")
    want = duckdb.sql(f"""
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM '{SF}/documents.parquet'),
        e AS (SELECT h, max(doc_id) AS m FROM d WHERE doc_id % 2 = 0 GROUP BY h), o AS (SELECT h, max(doc_id) AS m, count(*) AS n FROM d WHERE doc_id % 2 = 1 GROUP BY h)
        SELECT d.doc_id, coalesce(e.m, o.m) AS keep_id, o.n AS group_size, d.doc_id = coalesce(e.m, o.m) AS kept FROM d JOIN o USING (h) LEFT JOIN e USING (h) WHERE d.doc_id % 2 = 1
    """).fetchall()
    assert rows_of(got.collect()) == rows_of(want)
    assert got.where(~F.col("kept")).count() > 0
    index.close()


def test_hot_texts_among_many(spark):
    rows = [(i, "hot" if i % 3 == 0 else "warm" if i % 7 == 0 else f"t{i // 2}") for i in range(3000)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(batch(spark, rows)).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    assert got == {i: (max(groups[t]), len(groups[t])) for i, t in rows}


def test_writers_at_the_same_time_leave_one_owner_a_digest(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    exact_dedup.DigestIndex(spark, path, 4).close()
    got = {}

    def take(k):
        index = exact_dedup.DigestIndex(spark, path)
        got[k] = [tuple(r) for r in index.ingest(batch(spark, [(1000 * k + i, f"t{i}") for i in range(40 * k)])).select("doc_id", "keep_id").collect()]
        index.close()

    assert together(*(lambda k=k: take(k) for k in (1, 2, 3))) == []
    index = exact_dedup.DigestIndex(spark, path)
    owner = {bytes(r["digest"]): r["doc_id"] for r in index.table().collect()}
    assert len(owner) == index.table().count() == 120 and index.log.latest() == 3
    # Whichever batch came first, all agree on the owner of each text.
    owners = {}
    for rows in got.values():
        for doc_id, keep_id in rows:
            assert owners.setdefault(doc_id % 1000, keep_id) == keep_id
    assert set(owners.values()) == set(owner.values())
    index.close()


def test_a_batch_whose_writer_stopped_is_moved_in_by_the_next(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, path, 2)
    index.ingest(batch(spark, [(1, "a")])).count()
    settled, calls = index._settled, []
    monkeypatch.setattr(index, "_settled", lambda: (calls.append(1), settled())[1] if not calls else (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        index.ingest(batch(spark, [(2, "b"), (3, "a")]))
    again = exact_dedup.DigestIndex(spark, path)
    assert {(r["doc_id"], r["keep_id"]) for r in again.ingest(batch(spark, [(4, "b"), (5, "c")])).collect()} == {(4, 2), (5, 5)}
    again.close()
    index.close()


def test_a_digest_that_stands_twice_gives_one_row_a_document(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, path, 2)
    index.ingest(batch(spark, [(7, "a")])).count()
    index.table().selectExpr("digest", "doc_id + 1 AS doc_id").write.insertInto(index.name)
    assert [(r["doc_id"], r["keep_id"]) for r in index.ingest(batch(spark, [(9, "a")])).collect()] == [(9, 7)]
    index.close()
