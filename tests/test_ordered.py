"""Sweeps in bulk rounds against one item after another."""

import random

import pytest

from strataq.operators import graph, ordered, pairs


def plain_kept(ids, rules):
    kept, by = {}, {}
    for a, b in rules:
        by.setdefault(b, []).append(a)
    for i in sorted(ids):
        kept[i] = not any(kept[a] for a in by.get(i, ()))
    return kept


def plain_sweep(edges, importance):
    later = {}
    for a, b in edges:
        later.setdefault(a, set()).add(b)
    gone = set()
    for a in sorted(later):
        if a in gone:
            continue
        for b in sorted(later[a]):
            if b not in gone:
                gone.add(b if importance[a] >= importance[b] else a)
    return gone


def settled(spark, ids, rules):
    got = ordered.kept_in_order(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(rules, "early long, late long"))
    rows = got.collect()
    assert len(rows) == len(ids)
    return {r["id"]: r["kept"] for r in rows}


def swept(spark, edges, importance):
    df = spark.createDataFrame(edges, "a long, b long")
    return {r["vec_id"] for r in pairs.winner_takes_all(df, spark.createDataFrame(list(importance.items()), "vec_id long, importance double")).collect()}


@pytest.mark.parametrize("n, m", [(40, 60), (60, 300)])
def test_random_graphs(spark, n, m):
    rng = random.Random(n)
    edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
    assert settled(spark, range(n), edges) == plain_kept(range(n), edges)
    importance = {i: float(rng.randrange(4)) for i in range(n)}
    assert swept(spark, edges, importance) == plain_sweep(edges, importance)


@pytest.mark.parametrize("shape", ["star", "path", "clique"])
def test_large_shapes(spark, shape):
    n = 100_001
    edges = {"star": [(0, i) for i in range(1, n)], "path": [(i, i + 1) for i in range(n - 1)], "clique": [(i, j) for i in range(448) for j in range(i + 1, 448)]}[shape]
    importance = {i: float((i * 7919) % 13) for i in {x for e in edges for x in e}}
    assert swept(spark, edges, importance) == plain_sweep(edges, importance)


def test_a_path_is_run_through_by_doubling(spark):
    n = 20_000
    assert settled(spark, range(n), [(i, i + 1) for i in range(n - 1)]) == {i: i % 2 == 0 for i in range(n)}


def test_circles_raise(spark):
    for rules in ([(1, 2), (2, 1)], [(1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2)]):
        with pytest.raises(RuntimeError, match="wait"):
            settled(spark, (1, 2, 3, 4), rules)


def test_names_merge_as_in_a_fold(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["i1", "i2", None]), "".join(rng.choice("abA") for _ in range(rng.randrange(1, 7))), p) for p in range(300)] + [("i1", "é", 1), ("i2", "xéy", 2)]
    first = {}
    for inv, name, place in rows:
        key = (inv, name.lower())
        first[key] = min(first.get(key, place), place)
    want, known = set(), {}
    for (inv, name), place in sorted(first.items(), key=lambda x: (str(x[0][0]), x[1], x[0][1])):
        if inv is None:
            continue
        home = next((k for k in known.setdefault(inv, []) if name in k or k in name), None)
        if home is None:
            known[inv].append(name)
        want.add((inv, name, home or name, place))
    got = {tuple(r) for r in pairs.merged_entities(spark.createDataFrame(rows, "investigation_id string, name string, place long")).where("investigation_id IS NOT NULL").collect()}
    assert got == want and len({x[2] for x in want}) > 5


def test_receipts_prove_as_a_full_comparison_does(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    weight = [1 / (1 + i) for i in range(60)]
    sets = [(i, sorted(set(rng.choices(words, weight, k=rng.randrange(0, 25))))) for i in range(260)]
    names = ["", "a-b", "B", "c", None, "--"]
    found = [(i, t, names[i % 6]) for i, t in sets[:160]] + [(900, sets[3][1], names[3])]
    receipts = [(i, t, [names[i % 6], "zz"]) if i % 4 else (i, t, []) for i, t in sets[160:]] + [(990, None, None)]
    parts = lambda x: {p for p in __import__("re").split("[^a-z0-9]+", (x or "").lower()) if p}
    want = set()
    for i, t, s in found:
        ok = any(len(set(t) & set(r or ())) >= 0.45 * len(t) - 1e-9 and t and set(t) & set(r or ()) and (not s or parts(s) & set().union(set(), *map(parts, ns or ()))) for _, r, ns in receipts)
        if not ok:
            want.add(i)
    f, r = spark.createDataFrame(found, "id long, tokens array<string>, source string"), spark.createDataFrame(receipts, "id long, tokens array<string>, names array<string>")
    assert {x["id"] for x in pairs.unsupported(f, r).collect()} == want and 20 < len(want) < 150
    assert {x["id"] for x in pairs.unsupported(f, r.limit(0)).collect()} == {i for i, _, _ in found}
    assert pairs.unsupported(f.limit(0), r).count() == 0


def test_a_long_derivation_settles_in_few_rounds(spark, monkeypatch):
    n, made = 100_000, []
    chain = [(i, i - 1) for i in range(1, n)] + [(n + i, n + (i + 1) % 50) for i in range(50)] + [(2 * n + i, 2 * n + (i + 1) % 7) for i in range(7)]
    parents = spark.createDataFrame(chain, "child long, parent long")
    materialize = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: (made.append(label), materialize(df, label))[1])
    got = {r["node"] for r in graph.derived(spark.createDataFrame([(10,), (2 * n + 3,), (7 * n,)], "node long"), parents).collect()}
    assert got == set(range(10, n)) | {2 * n + i for i in range(7)} | {7 * n}
    assert made.count("derived-walk") <= 20


def test_several_parents_and_none(spark):
    parents = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "x"), ("d", "x"), (None, "a"), ("e", None)], "child string, parent string")
    of = lambda *xs: {r["node"] for r in graph.derived(spark.createDataFrame([(x,) for x in xs], "node string"), parents).collect()}
    assert of("a") == {"a", "b", "c"} and of("x") == {"x", "c", "d"} and of("q") == {"q"}
    assert {r["node"] for r in graph.derived(spark.createDataFrame([("a",)], "node string"), parents.limit(0)).collect()} == {"a"}
