"""Fingerprints against the generalised Jaccard similarity of the terms, and neighbours against sorting all documents."""

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strataq.llm import fingerprints as P

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    pieces = [w[i : i + P.LONG_WORD] for w in text.translate(LOWER).encode().split() for i in range(0, len(w), P.LONG_WORD)]
    return Counter(zip([None, *pieces], pieces))


def jaccard(x, y):
    a, b = terms(x), terms(y)
    both = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in both) / sum(max(a[k], b[k]) for k in both) if both else 1.0


def sentences(seed, n, words=60):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{k}" for k in rng.zipf(1.5, rng.integers(5, words))) for _ in range(n)]


def test_share_of_equal_places_is_the_generalised_jaccard_similarity():
    rng = np.random.default_rng(2)
    error, spread = [], []
    for round_ in range(8):
        texts = sentences(round_, 60)
        others = [" ".join([*t.split()[: rng.integers(1, 60)], *o.split(), *(t.split()[:3] * int(rng.integers(0, 4)))]) for t, o in zip(texts, sentences(100 + round_, 60, 20))]
        want = np.array([jaccard(*p) for p in zip(texts, others)])
        error += (P.likeness(*P.signatures(texts, others)) - want).tolist()
        spread += (want * (1 - want) / P.SAMPLES).tolist()
    expected = np.sqrt(np.mean(spread))
    assert abs(np.mean(error)) < 4 * expected / np.sqrt(len(error))
    assert 0.9 * expected < np.std(error) < 1.1 * expected


def test_draws_follow_their_distributions():
    u = (np.arange(1000) + 0.5) / 1000
    x = P.gamma_quantiles(u)
    assert np.abs(1 - (1 + x) * np.exp(-x) - u).max() < 1e-12
    low = np.exp(P._LN_C_LOW.astype(float))
    assert np.abs((-np.expm1(-low) - low * np.exp(-low)) / (P._GRID / 65536) - 1).max() < 1e-4


def test_a_text_has_one_fingerprint_whatever_is_beside_it(monkeypatch):
    texts = [*sentences(1, 20), "x" * 500, "A b", "a B", "", " \t\n", "é" * 90, " ".join(sentences(3, 60))]
    together = P.signatures(texts, texts[::-1])
    assert (together[0] == together[1][::-1]).all() and (together[2] == together[3][::-1]).all()
    monkeypatch.setattr(P, "BLOCK", 7)
    for i, t in enumerate(texts):
        assert (P.signatures([t])[0][0] == together[0][i]).all()
    assert (together[0][21] == together[0][22]).all()


def brute(rows):
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], (r[1] or "").encode()))
    out = []
    for i, (doc_id, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        sign = [P.signatures([t]) for t in (text, edited, after)]
        near = lambda a, b: float(P.likeness(a[0], b[0], a[2], b[2])[0])
        spelled = lambda s: "".join(f"{v:04x}" for v in s[0][0]) if s[2][0] else ""
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), spelled(sign[0]), spelled(sign[1]), near(sign[0], sign[1]), near(sign[0], sign[2])))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, r[2:])


def test_neighbours_over_ranges_of_any_number(spark, monkeypatch):
    texts = [*sentences(4, 70), None, "", "héllo 🙂 wörld ünï", "one", *["same text here it is"] * 5, "long" * 5000]
    rng = np.random.default_rng(0)
    rows = [(int(i), t, "en") for i, t in zip(rng.permutation(10**6)[: len(texts)], texts)] + [(None, "no id"), (5, "tie b"), (5, "tie a"), (5, "tie a")]
    rows = [(r[0], r[1], "en") for r in rows]
    want = sorted(brute(rows), key=key)
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_next string").repartition(5)
    for ranges in (1, 6):
        monkeypatch.setattr(P, "RANGES", ranges)
        got = P.edited_fingerprints(docs, [F.col("doc_id"), F.col("near_next")])
        assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        assert sorted((tuple(r) for r in got.collect()), key=key) == want
    both = P.fingerprint_documents(docs, [F.col("text").alias("_t")]).groupBy("_t").agg(F.countDistinct("fingerprint").alias("n")).where("n > 1")
    assert both.count() == 0


def test_likeness_of_strings_is_that_of_signatures(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*sentences(6, 20), "", " "])], "doc_id long, text string")
    got = P.edited_fingerprints(docs, [F.col("doc_id")]).withColumn("again", P.same_places(F.col("fingerprint"), F.col("edited_fingerprint")))
    assert got.where("again <> near_edited").count() == 0


def test_one_document_and_none(spark):
    one = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    r = P.edited_fingerprints(one, [F.col("doc_id")]).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(("a b c d e f g h"[:12] + "a b").encode()).hexdigest()
    assert P.edited_fingerprints(one.limit(0), [F.col("doc_id")]).collect() == []
