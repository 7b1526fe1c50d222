"""Operators on small fixtures with values worked out by hand or by a plain model."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strataq.functions import code, scoring, text
from strataq.operators import folds, graph, metrics, pairs, retrieval, windows
from strataq.operators.components import connected_components
from strataq.streaming import state


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_leave_generic_words_out(spark):
    got = one(spark, text.tokens(F.lit("The Host 10.0.0.5 contacted evil.example.com, host again: ab")))
    assert sorted(got) == ["10.0.0.5", "again:", "evil.example.com", "the"]
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []


def test_polarity_needs_whole_words(spark):
    assert one(spark, text.is_negated(F.lit("it is not so")))
    assert not one(spark, text.is_negated(F.lit("nothing noted")))
    assert one(spark, text.has_negation_marker(F.lit("a knot in it")))


def test_signature_and_severity(spark):
    got = one(spark, text.canonical_signature(F.lit("  Failed at 2024-01-02T03:04:05Z id deadbeef01  try 12 ")))
    assert got == "failed at <ts> id <hex> try <n>"
    assert one(spark, text.line_severity(F.lit("warning: job failed"))) == "error"
    assert one(spark, text.line_severity(F.lit("will retry"))) == "warning"


def test_truncation_backs_off_to_a_boundary(spark):
    assert one(spark, text.truncate_at_boundary(F.lit("One two. Three four five"), 14)) == "One two. …[truncated]"
    assert one(spark, text.truncate_at_boundary(F.lit("short"), 14)) == "short"


def test_named_entities_keep_first_spelling(spark):
    got = one(spark, text.named_entities(F.lit('Ada Lovelace met ada lovelace at "the mill" and Ada Lovelace on api.example.com')))
    assert got == ["Ada Lovelace", "the mill", "api.example.com"]
    assert one(spark, text.named_entity_type(F.lit("Ada Lovelace"))) == "person"


def test_scores(spark):
    v = lambda *x: F.array(*map(F.lit, map(float, x)))
    assert one(spark, scoring.cosine(v(1, 0), v(1, 1))) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, scoring.cosine(v(0, 0), v(1, 1))) == 0.0
    assert one(spark, scoring.weibull_retention(F.lit(7.0))) == pytest.approx(math.exp(-((7 / 30) ** 0.8)))
    assert one(spark, scoring.half_life(F.lit(7.0), 7.0)) == pytest.approx(0.5)
    assert one(spark, scoring.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)


def test_last_write_wins_and_unknown_states_are_passed_over(spark):
    log = spark.createDataFrame([("f1", 1, "fixed"), ("f1", 2, "open"), ("f1", 3, "nonsense"), ("f2", 1, "WONTFIX")], "finding_id string, seq long, resolution string")
    assert {tuple(r) for r in folds.resolution_overrides(log).collect()} == {("f1", "open"), ("f2", "WONTFIX")}
    gone = spark.createDataFrame([("f1", 1, True), ("f1", 2, False), ("f2", 1, None)], "finding_id string, seq long, active boolean")
    assert [r[0] for r in folds.retracted_ids(gone).collect()] == ["f2"]


def test_retraction_also_hides_repeated_text(spark):
    found = spark.createDataFrame([("f1", "i", "same "), ("f2", "i", "same"), ("f3", "j", "same"), ("f4", "i", "")], "id string, investigation_id string, text string")
    left = folds.without_retracted(found, spark.createDataFrame([("f1",)], "finding_id string"))
    assert sorted(r["id"] for r in left.collect()) == ["f3", "f4"]


def test_staleness_is_null_without_usable_refs(spark):
    refs = spark.createDataFrame([("a", "p", "1"), ("b", "p", "2"), ("c", "q", "1")], "id string, path string, hash string")
    now = spark.createDataFrame([("p", "1")], "path string, hash string")
    assert {r["id"]: r["stale"] for r in folds.staleness(refs, now).collect()} == {"a": False, "b": True, "c": None}


def test_budget_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(1, 1, "x" * 50), (1, 2, "x" * 60), (1, 3, "x")], "query int, place int, block string")
    got = windows.budget_cut(rows, ["query"], "place", F.length("block"), 100).collect()
    assert [(r["place"], r["total_chars"], r["truncated"]) for r in got] == [(1, 50, True)]


def test_rank_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate("zxwy")], "query int, id string, place int")
    relevant = spark.createDataFrame([(1, "x"), (1, "y")], "query int, id string")
    r = metrics.rank_metrics(ranked, relevant, 4).first()
    assert (r["recall"], r["mrr"]) == (1.0, 0.5)
    assert r["ndcg"] == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3)))


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(5, 5), (None, 3)]
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for a, b in edges if a is not None and a != b for x in (a, b)}


def test_containment_join_equals_all_pairs(spark):
    rng = random.Random(5)
    sets = {i: sorted({rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 9))}) for i in range(60)}
    df = spark.createDataFrame(list(sets.items()), "id int, tokens array<string>")
    got = {(r["l"], r["r"]) for r in pairs.containment_join(df, df, 0.5).collect()}
    assert got == {(a, b) for a in sets for b in sets if len(set(sets[a]) & set(sets[b])) >= 0.5 * len(sets[a])}
    near = {(r["a"], r["b"]) for r in pairs.jaccard_join(df, 0.6).collect()}
    assert near == {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= 0.6 * len(set(sets[a]) | set(sets[b]))}
    flags = df.withColumn("f", F.col("id") % 3 == 0)
    other = {tuple(sorted((r["l"], r["r"]))) for r in pairs.containment_join(flags, flags, 0.5, self_join=True, flag="f").collect()}
    assert other == {(a, b) for a in sets for b in sets if a < b and (a % 3 == 0) != (b % 3 == 0) and len(set(sets[a]) & set(sets[b])) >= 0.5 * min(len(sets[a]), len(sets[b]))}


def test_similar_vectors_and_greedy_clusters(spark):
    rng = random.Random(7)
    vecs = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, vec array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    near = pairs.similar_vectors(df, 0.9, pivots=6)
    assert {(r["a"], r["b"]) for r in near.collect()} == {(i, j) for i in range(80) for j in range(i + 1, 80) if cos(vecs[i], vecs[j]) >= 0.9}
    reps, owner = [], {}
    for i in range(80):
        owner[i] = next((r for r in reps if cos(vecs[r], vecs[i]) >= 0.9), i)
        if owner[i] == i:
            reps.append(i)
    assert {r["vec_id"]: r["rep"] for r in pairs.greedy_representatives(df, near).collect()} == owner


def test_contamination_follows_entities_and_derivation(spark):
    seeds = spark.createDataFrame([("f1",)], "node string")
    mentions = spark.createDataFrame([("f1", "u"), ("f2", "u"), ("f6", "w")], "node string, entity string")
    parents = spark.createDataFrame([("f3", "f2"), ("f4", "f3")], "child string, parent string")
    near = spark.createDataFrame([("f5",)], "node string")
    got = {r["node"]: r["reason"] for r in graph.contamination(seeds, mentions, parents, near).collect()}
    assert got == {"f1": "seed", "f2": "entity", "f3": "derived_from", "f4": "derived_from", "f5": "semantic"}
    assert {r["node"] for r in graph.contamination(seeds, mentions, spark.createDataFrame([], parents.schema), least_shared=2).collect()} == {"f1"}


def test_rrf_and_mmr(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query int, id int, place int")
    b = spark.createDataFrame([(1, 11, 1)], "query int, id int, place int")
    got = {r["id"]: r["score"] for r in retrieval.rrf([a, b]).collect()}
    assert got == pytest.approx({10: 1 / 61, 11: 1 / 62 + 1 / 61})
    rows = spark.createDataFrame([(1, 1, 1.0, ["a", "b"]), (1, 2, 0.99, ["a", "b"]), (1, 3, 0.9, ["c"])], "query int, item int, score double, words array<string>")
    assert [r["item"] for r in windows.greedy_mmr(rows, ["query"], "item", "score", "words", 2).orderBy("place").collect()] == [1, 3]


def test_guard_lets_only_reads_through():
    assert graph.read_only("SELECT * FROM calls")
    assert not graph.read_only("SELECT 1; DROP TABLE calls")
    assert not graph.read_only("create (n)")


def test_code_rows_and_rules():
    src = "import os\nfrom a.b import c as d\n\nclass K:\n    def run(self):\n        self.go()\n        d(1)\n        try:\n            os.remove('x')\n        except OSError:\n            pass\n\ndef test_x():\n    1 == 2\n"
    rows = code.analyse("pkg/test_m.py", src)
    assert ("pkg/test_m.py", "function", "K.run", "K", 5, 11, "") in rows
    assert {(r[2], r[6]) for r in rows if r[1] == "call"} == {("self.go", "self"), ("d", "none"), ("os.remove", "name")}
    assert {r[2] for r in rows if r[1] == "rule"} == {"swallowed-exception", "vacuous-test"}
    assert code.analyse("x.py", "def (")[0][1] == "error"


def test_stream_quorum_equals_closed_form(spark, tmp_path):
    rows = [(t, float(i * 100), 1.0 + i % 3) for i in range(12) for t in ("a", "b")]
    schema = "topic string, ts double, amount double"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    q = state.stream_quorum(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 600.0)
    run = q.writeStream.format("memory").queryName("quorum").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    last = {r["topic"]: r["level"] for r in spark.sql("SELECT topic, max_by(level, struct(ts, level)) AS level FROM quorum GROUP BY topic").collect()}
    batch = spark.createDataFrame(rows, schema).withColumn("reset", F.lit(False))
    want = {r["topic"]: r["level"] for r in state.quorum_levels(batch, 1100.0, 600.0).collect()}
    assert last == pytest.approx(want)


def test_logs_round_trip(spark, tmp_path):
    from strataq.sources import logs

    (tmp_path / "f.jsonl").write_text('{"id": "a", "type": "observed", "content": "x"}\n\nnot json\n{"id": "b", "record_type": "gap", "text": "y", "confidence": "HIGH"}\n')
    path = str(tmp_path / "f.jsonl")
    rows = {r["id"]: r for r in logs.normalised(logs.read_jsonl(spark, path)).collect()}
    assert (rows["a"]["record_type"], rows["a"]["text"], rows["a"]["confidence"]) == ("observed", "x", "low")
    assert rows["b"]["confidence"] == "high" and logs.bad_lines(spark, path) == 1
    manifest = spark.createDataFrame([("i",)], "id string")
    found = spark.createDataFrame([("i", 1, "a", "t", "gap", "low")], "investigation_id string, seq long, id string, text string, record_type string, confidence string")
    good, bad = logs.import_bundle(logs.export_bundle(manifest, found).select("bundle"), F.lit("j"))
    assert [(r["investigation_id"], r["id"]) for r in good.collect()] == [("j", "a")] and bad.count() == 0


def test_callables_validate_what_models_return(spark):
    from strataq.functions import callables

    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "abc")], "id int, t string")
    vec = callables.embedder(lambda ts: [[float(len(t)), 1.0] if t else [] for t in ts], 2)
    assert [r[0] for r in rows.select(vec("t")).collect()] == [[2.0, 1.0], None, [3.0, 1.0]]
    assert [r["generated"] for r in callables.generate(rows, "t", lambda ps: [p.upper() for p in ps]).orderBy("id").collect()] == ["AB", "", "ABC"]
    assert one(spark, callables.classified(F.lit(" It is Spam. "), ("ham", "spam"), "ham")) == "spam"
    assert one(spark, callables.compressed(F.lit(""), F.lit("long text"), 4)) == "long"
    assert one(spark, callables.sequence_ratio()(F.lit("abcd"), F.lit("bcde"))) == 0.75
    hits = spark.createDataFrame([(1, 1, 1, 0.1), (1, 2, 2, 0.9), (2, 1, 1, 0.1), (2, 2, 2, None)], "query int, id int, place int, s double")
    got = {(r["query"], r["id"]): r["place"] for r in callables.rerank_all_or_none(hits, F.col("s"), 2).collect()}
    assert got == {(1, 2): 1, (1, 1): 2, (2, 1): 1, (2, 2): 2}


def test_reflection_stream_suppresses_what_it_knows(spark, tmp_path):
    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("".join(f'{{"line": "job {i} failed", "seq": {i}}}\n' for i in range(2)))
    state.reflect(spark, str(tmp_path / "in"), "line string, seq long", str(tmp_path / "out"), str(tmp_path / "cp"), files=1).awaitTermination()
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 2]


def test_what_is_referred_to_together_is_dealt_out_by_its_number(spark, monkeypatch):
    from strataq.operators import graph

    monkeypatch.setattr(graph, "PAIRED", 20)
    rng = random.Random(3)
    rows = [(rng.randrange(60), rng.randrange(12), rng.randrange(3)) for _ in range(500)]
    refs = spark.createDataFrame(rows, "finding long, symbol long, investigation long")
    symbols = spark.createDataFrame([(i,) for i in (*range(9), 3)], "symbol long")
    held = {}
    for f, s, _ in rows:
        held.setdefault(f, set()).add(s)
    shared = {}
    for s in held.values():
        for a in s:
            for b in s - {a}:
                shared[a, b] = shared.get((a, b), 0) + 1
    want = []
    for a in range(9):
        best = sorted((-n, b) for (x, b), n in shared.items() if x == a)[:4]
        want += [(a, b, -n, k + 1) for k, (n, b) in enumerate(best)]
    found = graph.co_referenced(refs, symbols, 4)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    n = -(-sum(map(len, held.values())) // 20)
    assert n > 10 and f", {2 * n})" in found._jdf.queryExecution().executedPlan().toString()
    got = {r["symbol"]: r["co_referenced"] for r in graph.impact(refs, symbols).collect()}
    assert got == {a: len({b for x, b in shared if x == a}) for a in range(9)}
