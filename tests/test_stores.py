"""Ledgers, relabelling, replay and merges on small fixtures."""

import pytest
from pyspark.sql import functions as F

from strataq.operators import grounding, stores
from tests_support import rows_of


def test_promotion_names_the_model_it_replaces(spark):
    ledger = spark.createDataFrame([("gate", "aa", "1"), ("gate", "bb", "2"), ("other", "cc", "3")], "model string, sha256 string, promoted_at string")
    assert stores.promotion(ledger, "gate", "dd", "{}", "4").first()["previous_sha256"] == "bb"
    assert stores.promotion(ledger, "new", "dd", "{}", "4").first()["previous_sha256"] is None


def test_canary_holds_small_runs_back_and_compares_means(spark):
    rows = [(r, i, int(i < 5), 0.9 if i < 3 + r else 0.1, 0.9 if i < 5 else 0.1) for r in (0, 1) for i in range(10)] + [(2, 0, 1, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "run int, finding int, label int, base double, model double")
    got = stores.canary(df, 0.5).first()
    f1 = [2 * 3 / 8, 2 * 4 / 9]
    mean = sum(f1) / 2
    assert (got["n_runs"], got["n_findings"], got["decision"]) == (2, 20, "PROMOTE") and got["model_f1"] == 1 and got["model_std"] == 0
    assert got["base_f1"] == pytest.approx(mean) and got["base_std"] == pytest.approx(abs(f1[0] - mean))
    assert stores.canary(df.withColumn("model", F.col("base")), 0.5).first()["decision"] == "HOLD"
    assert stores.canary(df.limit(0), 0.5).first()["decision"] == "HOLD"


def test_replayed_findings_are_consolidated(spark):
    shape = "seq long, id string, text string"
    batch = spark.createDataFrame([(2, "b", "y" * 300), (1, "a", "x")], shape)
    near = spark.createDataFrame([], shape)
    answer = F.array_join(F.transform("batch", lambda x: x["t"]), "+")
    got = stores.consolidated(batch, near, answer, 9).first()
    assert got["text"] == "x+" + "y" * 200 and got["derived_from"] == ["a", "b"] and (got["batch_size"], got["interleaved"], got["importance"]) == (2, 0, 0.75)


def test_only_fitting_answers_relabel_a_failure(spark):
    rows = [(1, "c" * 300, "This trace shows how to list files"), (2, "c", "This trace"), (3, "c", "No, it failed badly this time"), (4, "c", None)]
    got = stores.relabelled(spark.createDataFrame(rows, "id long, content string, answer string")).collect()
    assert [r["original_id"] for r in got] == ["1"] and got[0]["content"].endswith("\nOriginal: " + "c" * 200)


def test_stale_vectors_are_made_anew(spark):
    rows = spark.createDataFrame([(1, "a", [1.0], "m", 1), (2, "b", [2.0], "m", 1)], "id long, text string, vec array<double>, model string, version int")
    got = stores.reembedded(rows, rows.where("id = 2").select("id"), F.array(F.length("text").cast("double") * 7), "n", 2)
    assert rows_of((r["id"], r["vec"][0], r["model"], r["version"]) for r in got.collect()) == rows_of([(1, 1.0, "m", 1), (2, 7.0, "n", 2)])
    assert stores.anchors(rows, 1).count() == 1


def test_recalled_rows_belong_to_the_investigation(spark):
    rows = [("q", i, s, c, m) for i, (s, c, m) in enumerate([(0.9, "a", {"investigation_id": "x"}), (0.8, " ", {"investigation_id": "x"}), (0.7, "b", {"investigation": "x", "confidence": "high"}), (0.6, "c", {}), (0.5, None, {"investigation": "x"}), (0.4, "d", {"investigation_id": "x"})])]
    hits = spark.createDataFrame(rows, "query string, id int, score double, content string, metadata map<string,string>")
    got = stores.recall_rows(hits, "x", 2).orderBy("id").collect()
    assert [(r["id"], r["confidence"]) for r in got] == [(0, "low"), (2, "high")]
    assert stores.recall_rows(hits, None, 9).count() == 4


def test_conflicts_are_resolved_once(spark):
    rows = spark.createDataFrame([("a", "b", "open"), ("c", "d", "open")], "finding_id_a string, finding_id_b string, status string")
    out, gone = stores.resolved_conflict(rows, "a", "b", "a_wins", "now")
    assert {(r["finding_id_a"], r["status"], r["resolved_at"]) for r in out.collect()} == {("a", "a_wins", "now"), ("c", "open", None)} and [r["id"] for r in gone.collect()] == ["b"]
    assert stores.resolved_conflict(rows, "a", "b", "both_valid", "now")[1].count() == 0
    out, gone = stores.resolved_conflict(rows, "a", "b", "false_positive", "now")
    assert gone.count() == 0 and {r["status"] for r in out.collect()} == {"false_positive", "open"}
    with pytest.raises(ValueError):
        stores.resolved_conflict(rows, "a", "b", "neither", "now")


def test_first_seed_and_pruning(spark):
    seeds = spark.createDataFrame([("q", 1, 0), ("q", 2, 1), ("q", 3, 1), ("r", 1, 0)], "query string, place int, ok int")
    assert [(r["query"], r["place"]) for r in grounding.first_qualifying(seeds, F.col("ok") == 1).collect()] == [("q", 2)]
    rows = spark.createDataFrame([("a", 0.5, 1), ("b", 0.9, 1), ("c", 0.5, 2)], "id string, score double, created_at_ts long")
    assert [r["id"] for r in grounding.pruned(rows, 2).collect()] == ["b", "c"]


def test_cascade_fills_up_from_the_second_store(spark):
    shape = "query int, id string, score double"
    first = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.8), (2, "x", 0.9), (2, "y", 0.8), (2, "z", 0.7)], shape)
    second = spark.createDataFrame([(1, "b", 9.0), (1, "c", 5.0), (1, "d", 4.0), (2, "w", 9.0), (3, "v", 1.0)], shape)
    got = {(r["query"], r["id"], r["origin"]) for r in grounding.cascade(first, second, 3).collect()}
    assert got == {(1, "a", "primary"), (1, "b", "primary"), (1, "c", "secondary"), (2, "x", "primary"), (2, "y", "primary"), (2, "z", "primary"), (3, "v", "secondary")}


def test_hybrid_without_sparse_or_reranker(spark):
    shape = "query int, id int, score double"
    dense = spark.createDataFrame([(1, i, 1.0 / (1 + i)) for i in range(30)], shape)
    assert [r["id"] for r in grounding.hybrid(dense, None, 3).orderBy("place").collect()] == [0, 1, 2]
    texts = spark.createDataFrame([(1, i, i) for i in range(30)], "query int, id int, n int")
    got = grounding.hybrid(dense, None, 5, F.col("n").cast("double"), texts, rerank_top_k=2).orderBy("place").collect()
    assert [r["id"] for r in got] == [9, 8]


def test_code_verdicts_and_ingested_tables(spark):
    from strataq.functions import code

    src = "from .b import g\n\nclass K:\n    def run(self):\n        self.stop()\n        g()\n    def stop(self):\n        try:\n            x()\n        except E:\n            pass\n        a._b.c().d().e()\n"
    rows = code.parse_python(spark.createDataFrame([("p/a.py", src), ("p/b.py", "def g(): ...\n")], "path string, content string"))
    got = {(r["verdict_type"], r["decision"], r["excerpt"]) for r in stores.code_verdicts(rows, 5).collect()}
    assert got == {("OG1", "block", "p/a.py:10:OG1"), ("LH001", "block", "p/a.py:12:LH001"), ("H4", "warn", "p/a.py:12:H4")}
    graph = {k: {tuple(r) for r in df.collect()} for k, df in stores.ingested(rows).items()}
    assert graph["calls"] == {("p/a.py::K.run", "p/a.py::K.stop", "self"), ("p/a.py::K.run", "p/b.py::g", "import")}
    assert graph["imports"] == {("p/a.py", "p.b.g")} and ("p/a.py::K", "p/a.py::K.run") in graph["contains"] and ("p/b.py", "p/b.py::g") in graph["contains"]
    assert {x[0] for x in graph["symbols"]} == {"p/a.py::K", "p/a.py::K.run", "p/a.py::K.stop", "p/b.py::g"}


def test_a_sweep_needs_enough_that_is_new(spark):
    none = spark.createDataFrame([], "id string")
    assert stores.swept(none, none, none, none, 1, 999) == {} and stores.swept(none, none, none, none, 9, 199) == {}


def test_the_watermark_only_moves_on_a_clean_run(spark):
    rows = spark.createDataFrame([("2026-01-02",), ("2026-01-01",)], "ts string")
    assert stores.advanced("2026-01-01", rows, "ts", True) == "2026-01-02" and stores.advanced("2026-01-01", rows, "ts", False) == "2026-01-01"
    assert stores.advanced("2026-02-01", rows, "ts", True) == "2026-02-01" and stores.advanced(None, rows.limit(0), "ts", True) is None


def test_reflection_states_and_their_queue():
    state = stores.reflection_state({"ticks": 3, "queue": None, "more": 1})
    assert state == {"status": "idle", "ticks": 3, "last_tick": None, "queue": [], "seen": [], "more": 1}
    state = stores.seeded(state, ["a", "b", "a", ""])
    assert state["queue"] == ["a", "b"] and state["status"] == "queued"
    first, state = stores.ticked(state, "now")
    assert first == "a" and state["seen"] == ["a"] and state["ticks"] == 4 and stores.seeded(state, ["a", "b"])["queue"] == ["b"]
    _, state = stores.ticked(state, "now")
    assert stores.ticked(state, "later") == (None, state | {"status": "idle"}) and stores.REFLECTION["queue"] == []
