"""Logs, manifests and source trees on disk: compaction, swaps, scanners and guards."""

import json

import pytest
from pyspark.sql import functions as F

from strataq import storage
from strataq.sources import logs
from tests_support import together

SHAPE = "id string, created_at_ts long"


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(r if isinstance(r, str) else json.dumps(r) + "\n" for r in rows))


def ids(spark, path):
    return sorted(r["id"] for r in logs.read_jsonl(spark, path, SHAPE).collect())


@pytest.fixture
def live(tmp_path):
    lines(tmp_path / "live" / "a.jsonl", [{"id": "old", "created_at_ts": 1}, {"id": "new", "created_at_ts": 9}, {"id": "none"}])
    return f"file://{tmp_path}/live"


def test_compaction_in_place_keeps_every_entry_once(spark, live, tmp_path):
    archive = f"file://{tmp_path}/archive"
    for _ in range(2):
        logs.compact(spark, live, F.col("created_at_ts") < 5, archive, "2026-01", SHAPE)
        assert ids(spark, live) == ["new", "none"]
        if _ == 0:
            assert ids(spark, archive) == ["old"]
    logs.append_jsonl(spark.createDataFrame([("older", 2)], SHAPE), live)
    logs.compact(spark, live, F.col("created_at_ts") < 5, archive, "2026-02", SHAPE)
    assert ids(spark, live) == ["new", "none"] and "older" in ids(spark, archive)


@pytest.mark.parametrize("at", ["before", "between"])
def test_a_swap_that_was_cut_off_is_finished_or_undone(spark, live, tmp_path, at):
    lines(tmp_path / "live.new" / "a.jsonl", [{"id": "new", "created_at_ts": 9}])
    if at == "between":
        (tmp_path / "live").rename(tmp_path / "live.old")
    logs.compact(spark, live, F.col("created_at_ts") < 0, f"file://{tmp_path}/archive", "r", SHAPE)
    assert ids(spark, live) == (["new"] if at == "between" else ["new", "none", "old"])
    assert not (tmp_path / "live.old").exists() and not (tmp_path / "live.new").exists()


def test_broken_and_blank_lines_are_left_out_and_counted(spark, tmp_path):
    lines(tmp_path / "log" / "a.jsonl", [{"id": "a", "created_at_ts": 1}, "\n", "{broken\n", {"id": "b"}])
    path = f"file://{tmp_path}/log"
    assert ids(spark, path) == ["a", "b"] and logs.bad_lines(spark, path, SHAPE) == 1
    tail = logs.tail_lines(spark, path, 2)
    assert [r["value"] for r in tail.orderBy("line_no").collect()][-1] == '{"id": "b"}' and tail.count() == 2


def test_files_with_a_nul_are_no_text(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "b.bin": bytes([0x10, 0x01, 0x41, 0x00]), "c.bin": b"\0", "d.py": bytes([0x10, 0x01]) + b"y"}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "f.py").write_bytes(b"z")
    got = {r["path"].rsplit("/", 1)[1]: r["content"] for r in logs.source_files(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.py": "x = 1\n", "d.py": "\x10\x01y"}


def test_manifests_are_replaced_by_id(spark, tmp_path):
    path, shape = f"file://{tmp_path}/manifests", "id string, title string, acl array<string>"
    logs.saved_manifests(spark, spark.createDataFrame([("a", "one", ["x"]), ("b", "two", None)], shape), path)
    logs.saved_manifests(spark, spark.createDataFrame([("b", "three", None), ("c", "four", [])], shape), path)
    table = logs.manifests(spark, path)
    assert sorted((r["id"], r["title"]) for r in table.collect()) == [("a", "one"), ("b", "three"), ("c", "four")]
    assert logs.manifest(table, "b").first()["acl"] == [] and logs.manifest(table, "a").first()["acl"] == ["x"] and logs.manifest(table, "no").count() == 0


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    path, shape = f"file://{tmp_path}/manifests", "id string, title string, acl array<string>"
    log = f"file://{tmp_path}/log"
    save = lambda i: logs.saved_manifests(spark, spark.createDataFrame([("same", f"t{i}", []), (f"m{i}", "own", [])], shape), path)
    save(9)
    assert together(*(lambda i=i: save(i) for i in range(3)), *(lambda i=i: logs.append_jsonl(spark.createDataFrame([(f"e{i}", i)], SHAPE), log) for i in range(3))) == []
    got = sorted(r["id"] for r in logs.manifests(spark, path).collect())
    assert got == ["m0", "m1", "m2", "m9", "same"] and ids(spark, log) == ["e0", "e1", "e2"]
    assert sorted(r["id"] for r in logs.manifests(spark, path, 2).collect()) == ["m9", "same"]


def test_recent_audit_reads_the_last_days_only(spark, tmp_path):
    for day, rows in {"2026-01-01": ["{no json\n"], "2026-01-09": [{"ts": "2026-01-09T1", "action": "b"}], "2026-01-10": [{"ts": "2026-01-10T1", "action": "c"}, {"ts": "2026-01-10T3", "action": "d"}]}.items():
        lines(tmp_path / f"audit-{day}.jsonl", rows)
    got = lambda n, days: [r["action"] for r in logs.recent_audit(spark, f"file://{tmp_path}", "2026-01-10", n, days).collect()]
    assert got(9, 2) == ["d", "c", "b"] and got(2, 2) == ["d", "c"] and got(9, 1) == ["d", "c"]
    assert logs.recent_audit(spark, f"file://{tmp_path}/none", "2026-01-10", 5).count() == 0


def test_session_logs_of_four_kinds(spark, tmp_path):
    lines(tmp_path / "messages" / "a.jsonl", [{"role": "user", "content": "hi", "ts": "1"}, "broken\n", {"role": "user", "content": " "}])
    lines(tmp_path / "events" / "a.jsonl", [{"type": "m", "timestamp": "2", "message": {"role": "assistant", "content": "yo"}}, {"type": "tick"}])
    lines(tmp_path / "document" / "a.json", [json.dumps({"session_id": "s", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]}, indent=1)])
    lines(tmp_path / "text" / "a.log", ["line one\n", "\n", "line two\n"])
    want = {"messages": [("user", "hi")], "events": [("assistant", "yo")], "document": [("user", "q"), ("assistant", "r")], "text": [("process", "line one"), ("process", "line two")]}
    for kind, rows in want.items():
        got = logs.session_log(spark, f"file://{tmp_path}/{kind}", kind)
        assert [(r["role"], r["text"]) for r in got.orderBy("line_no").collect()] == rows and got.columns == ["file", "line_no", "role", "text", "ts"]


def test_sweep_deletes_what_is_left(spark):
    df = storage.materialize(spark.range(3), "sweep-test")
    storage.sweep(spark)
    with pytest.raises(Exception, match="(?i)exist|not find"):
        spark.read.parquet(df._strataq_path).count()
    assert storage.sweep(spark) == 0
