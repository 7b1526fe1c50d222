"""The filters before verification lose no similar pair and take most others away."""

import random
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from strataq.llm import ngram_join as N
from strataq.llm import shingles as S


def sets_of(texts, width):
    return [S.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), width)[0] for t in texts]


def near_copies(rng, n):
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 200))]
        for _ in range(rng.randrange(2, 5)):
            copy = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 8)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy + [rng.choice(vocabulary)] * rng.randrange(0, 3)))
    return out


def test_parity_bounds_the_overlap_from_above():
    rng = np.random.default_rng(3)
    close = 0
    for k in range(400):
        pool = rng.integers(0, 2**63, 700, dtype=np.uint64)
        n = int(rng.integers(1, 600))
        # Sizes as far apart as those of candidates, and every fourth time any.
        m = int(rng.integers(1, 600)) if k % 4 == 0 else int(n * rng.uniform(0.8, 1.0)) + 1
        s, t = (np.unique(rng.choice(pool, size, replace=False)) for size in (n, m))
        common, most = len(np.intersect1d(s, t)), N.most_common(N.parity(s), N.parity(t), n, m)
        assert common <= most
        close += k % 4 > 0 and most - common <= 0.1 * (n + m)
    assert close >= 270 and N.most_common(N.parity(pool[:0]), N.parity(pool[:0]), 0, 0) == 0


def test_filters_lose_no_similar_pair_and_most_others(spark):
    rng, width, threshold = random.Random(7), 4, (85, 100)
    texts = near_copies(rng, 40)
    sets = sets_of(texts, width)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(np.intersect1d(sets[i], sets[j]))]
    similar = {(i, j) for i, j in pairs if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - c)}
    sketch = SimpleNamespace(value=np.zeros(1 << N.BITS, np.uint8).tobytes())
    text = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, _text string")
    given = spark.createDataFrame(pairs, "x long, y long")
    left = {}
    for orders in (1, 2, 4):
        got = N.filtered(given, N._index(text, width, threshold, sketch, orders), threshold, orders)
        left[orders] = {(r["x"], r["y"]) for r in got.collect()}
        assert similar <= left[orders]
    assert left[4] <= left[2] <= left[1] and len(left[1] - similar) < 0.5 * len(set(pairs) - similar) and similar


def test_a_second_order_alone_takes_candidates_away():
    """Without the bitmap: pairs that share one rare token of the first order seldom meet under the others too."""
    rng, threshold = random.Random(1), (85, 100)
    sketch = np.zeros(1 << N.BITS, np.uint8)
    one = two = 0
    for _ in range(300):
        shared = [rng.getrandbits(64) for _ in range(rng.randrange(1, 20))]
        s, t = (np.unique(np.array(shared + [rng.getrandbits(64) for _ in range(100)], np.uint64)) for _ in "xy")
        need = -(85 * (len(s) + len(t)) // -185)
        p, q = (N.prefixes([x], sketch, threshold, range(2))[0] for x in (s, t))
        meet = [bool(len(np.intersect1d(p[k][: len(s) - need + 1], q[k][: len(t) - need + 1]))) for k in (0, 1)]
        one, two = one + meet[0], two + all(meet)
    assert 0 < two < 0.7 * one


def test_the_sketch_counts_whole_texts_in_two_steps(spark):
    texts = ["a b c d e f"] * 9 + ["x y z w"] * 3
    text = spark.createDataFrame([(t,) for t in texts], "_text string").repartition(5)
    got = N.token_sketch(text, 4)
    for t, n in (("a b c d e f", 9), ("x y z w", 3)):
        for token in sets_of([t], 4)[0]:
            assert got[int(token >> N._SHIFT)] == round(8 * np.log2(1 + n))
    assert (got > 0).sum() == 4 and N.token_sketch(text.where(F.lit(False)), 4).sum() == 0
