"""Mixing equals a slot-by-slot simulation, and planning stays fast with many sources."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataq.llm import mixing


def simulate(parts, blocks):
    """The source of every slot by trying all sources at every slot; shares are those of the sources that still have blocks."""
    left, out, start, done = list(blocks), [], 0, [0] * len(parts)
    while any(left):
        live = [p if n else 0 for p, n in zip(parts, left)]
        total = sum(live)
        t = len(out) - start
        best = min((-(-(done[s] + 1) * total // p), s) for s, p in enumerate(live) if p and done[s] * total // p <= t)
        s = best[1]
        done[s] += 1
        left[s] -= 1
        out.append(s)
        if not left[s]:
            start, done = len(out), [0] * len(parts)
    return out


def slots_of(phases, blocks):
    out = {}
    for s, (mine, n) in enumerate(zip(phases, blocks)):
        for b in range(n):
            p = [x for x in mine if x["first"] <= b][-1]
            i = b - p["first"]
            out[p["start"] + i // p["part"] * p["period"] + p["slots"][i % p["part"]]] = s
    return [out[t] for t in range(len(out))]


def test_phases_equal_a_simulation():
    rng = random.Random(12)
    for _ in range(150):
        parts = [rng.randrange(1, 9) for _ in range(rng.randrange(1, 7))]
        blocks = [rng.randrange(0, 30) for _ in parts]
        assert slots_of(mixing.plan_phases(parts, blocks), blocks) == simulate(parts, blocks)


@pytest.mark.parametrize("many", [False, True])
def test_the_order_equals_a_plain_one(spark, monkeypatch, many):
    if many:
        monkeypatch.setattr(mixing, "GROUP", 2)
    rng = random.Random(5)
    rows = [(i, "x" * rng.randrange(0, 90), rng.choice(["a", "a", "b", "c", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights, chars = {"a": 3, "c": 2}, 200
    got = mixing.mix(docs, weights, block_chars=chars, bucket_rows=8).collect()
    key = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64(F.lit("mix"), "doc_id")).collect()}
    names = sorted({s or "" for _, _, s in rows})
    want, totals = {}, []
    for s in names:
        mine = [(i, len(t) + 1) for i, t, o in rows if (o or "") == s]
        n = -(-len(mine) // 8)
        at = 0
        for i, size in sorted(mine, key=lambda x: (key[x[0]] % n, key[x[0]], x[0])):
            want[i] = (s, at // chars, at % chars)
            at += size
        totals.append(-(-at // chars))
    order, seen, slot = simulate([weights.get(s, 1) for s in names], totals), Counter(), {}
    for t, s in enumerate(order):
        slot[(names[s], seen[s])] = t
        seen[s] += 1
    assert {r["doc_id"]: (r["source"], r["block"], r["block_offset"], r["slot"]) for r in got} == {i: (*v, slot[v[:2]]) for i, v in want.items()}


def test_many_sources_are_planned_in_seconds():
    began = time.perf_counter()
    phases = mixing.plan_phases([1 + i % 3 for i in range(2000)], [40] * 2000)
    assert time.perf_counter() - began < 20 and all(phases)


def test_common_factors_of_weights_change_nothing():
    blocks = [40, 7, 90]
    plan = lambda parts: [[{k: v for k, v in p.items() if k not in ("part", "period")} | {"slots": [x for x in p["slots"]]} for p in ph] for ph in mixing.plan_phases(parts, blocks)]
    assert plan([500, 1000, 1500]) == plan([1, 2, 3])
    many = mixing.plan_phases([500] * 100, list(range(50, 150)))
    assert sum(len(p["slots"]) for ph in many for p in ph) <= 100 * 100


def test_too_many_slots_raise(monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SLOTS", 100)
    with pytest.raises(ValueError, match="slots"):
        mixing.plan_phases([7, 90, 14], [10**6, 10**6, 10**6])
