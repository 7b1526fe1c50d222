"""Versioned tables: commits of writers that work at the same time, pinned readers, and deleted places."""

import pytest
from pyspark.sql import functions as F

from strataq.sources import versions as V
from tests_support import together

SHAPE = "k string, n long"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SHAPE)


def held(df):
    return sorted((r["k"], r["n"]) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return V.VersionedTable(spark, f"file://{tmp_path}/t", rows(spark).schema)


def test_every_version_stays_as_it_was(spark, table):
    table.append(rows(spark, ("a", 1), ("b", 2), (None, 3)))
    table.upsert(rows(spark, ("b", 20), ("c", 30)), "k")
    table.delete(F.col("n") == 1)
    table.insert_new(rows(spark, ("c", 99), ("d", 4)), "k")
    seen = {v: held(table.read(v)) if v > 1 and v not in (2, 3, 4, 5) else sorted((r["k"] or "", r["n"]) for r in table.read(v).collect()) for v in range(1, 6)}
    assert seen == {1: [], 2: [("", 3), ("a", 1), ("b", 2)], 3: [("", 3), ("a", 1), ("b", 20), ("c", 30)], 4: [("", 3), ("b", 20), ("c", 30)], 5: [("", 3), ("b", 20), ("c", 30), ("d", 4)]}
    assert table.rewrite(1) == 6 and table.state(6)[1] == [] and len(table.state(6)[0]) == 1
    assert sorted(r["n"] for r in table.read().collect()) == [3, 4, 20, 30] and sorted(r["n"] for r in table.read(3).collect()) == [1, 3, 20, 30]
    assert table.expire(1) > 0 and sorted(r["n"] for r in table.read().collect()) == [3, 4, 20, 30]
    again = V.VersionedTable(spark, table.path)
    assert again.version() == 6 and again.schema.names == ["k", "n"]
    with pytest.raises(ValueError, match="schema"):
        V.VersionedTable(spark, table.path, spark.range(1).schema)
    with pytest.raises(ValueError, match="no table"):
        V.VersionedTable(spark, table.path + "-none")


def test_writers_that_start_together_all_land(spark, table):
    assert together(*(lambda i=i: table.append(rows(spark, (f"k{i}", i))) for i in range(4))) == []
    assert held(table.read()) == [(f"k{i}", i) for i in range(4)] and table.version() == 5
    # Upserts of one key: whichever comes last stands, and there is one row of it.
    assert together(*(lambda i=i: table.upsert(rows(spark, ("k0", 100 + i), (f"new{i}", i)), "k") for i in range(3))) == []
    got = held(table.read())
    assert len(got) == 7 and dict(got)["k0"] in (100, 101, 102)
    assert together(*(lambda i=i: table.insert_new(rows(spark, ("once", i)), "k") for i in range(3))) == []
    assert [k for k, _ in held(table.read())].count("once") == 1


def test_a_conflict_has_a_name(spark, table):
    table.append(rows(spark, ("a", 1)))
    put = table.log.put

    def late(version, commit):
        if commit["op"] == "upsert":
            table.log.put = put
            V.VersionedTable(spark, table.path).append(rows(spark, ("b", 2)))
            done = put(version, commit)
            table.log.put = late
            return done
        return put(version, commit)

    table.log.put = late
    with pytest.raises(V.CommitConflict, match="version 3 .* changed rows"):
        table.upsert(rows(spark, ("a", 5)), "k", tries=1)
    table.log.put = put
    assert held(table.read()) == [("a", 1), ("b", 2)]


def test_appends_beside_a_rewrite_stay(spark, table):
    for i in range(3):
        table.append(rows(spark, (f"k{i}", i)))
    table.delete(F.col("k") == "k1")
    assert together(lambda: table.rewrite(), lambda: table.append(rows(spark, ("late", 9)))) == []
    assert held(table.read()) == [("k0", 0), ("k2", 2), ("late", 9)]


def test_long_logs_are_folded_from_the_last_whole_state(spark, table, monkeypatch):
    monkeypatch.setattr(V, "STATE_EVERY", 3)
    for i in range(7):
        table.append(rows(spark, (f"k{i}", i)))
    reads, read = [], table.log.read
    table.log.read = lambda v: (reads.append(v), read(v))[1]
    assert held(table.read()) == [(f"k{i}", i) for i in range(7)] and len(reads) <= 3
    assert held(table.read(5)) == [(f"k{i}", i) for i in range(4)]


def test_files_of_a_writer_that_failed_are_not_read(spark, table):
    table.append(rows(spark, ("a", 1)))
    table._written(rows(spark, ("lost", 1)))
    assert held(table.read()) == [("a", 1)] and table.expire(5) == 1
