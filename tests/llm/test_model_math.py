"""The models' arithmetic against plain loops: recurrent states, gradients, covariances, scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.llm import language_id, quality_classifier


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain_document(net, raw):
    """Mean probabilities over a text's bytes: one byte, one unit and one window at a time."""
    hidden, total = net.recur.shape[1], np.zeros(len(net.langs))
    for at in range(0, len(raw), language_id.WINDOW):
        window = raw[at : at + language_id.WINDOW]
        states = np.zeros((len(window), 2 * hidden))
        for d in (0, 1):
            h = [0.0] * hidden
            for place in range(len(window)) if d == 0 else reversed(range(len(window))):
                a = net.table[d, window[place]]
                g = [sum(h[j] * net.recur[d, j, k] for j in range(hidden)) for k in range(3 * hidden)]
                new = []
                for k in range(hidden):
                    z, r = sigmoid(a[k] + g[k]), sigmoid(a[hidden + k] + g[hidden + k])
                    n = math.tanh(a[2 * hidden + k] + r * g[2 * hidden + k])
                    new.append((1 - z) * n + z * h[k])
                h = new
                states[place, d * hidden : (d + 1) * hidden] = h
        for s in states:
            e = np.exp(s @ net.out[:-1] + net.out[-1])
            total += e / e.sum()
    return total / max(1, len(raw))


def test_windowed_inference_equals_a_plain_loop():
    net = language_id.Network.start(["aa", "bb", "cc"], 4, 5)
    rng = random.Random(3)
    texts = ["", "a", "x" * 63, "y" * 64, "z" * 65, "Grüße, 日本 😀 " * 20] + ["".join(rng.choice("abc é\n") for _ in range(rng.randrange(1, 300))) for _ in range(12)]
    raw = [t.encode() for t in texts]
    got = net.documents(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), chunk=3)
    for g, r in zip(got, raw):
        assert g == pytest.approx(plain_document(net, r), abs=1e-5)


def test_gradients_of_every_table_equal_differences():
    rng = np.random.default_rng(6)
    net = language_id.Network.start(["aa", "bb", "cc"], 3, 2)
    net.table, net.recur, net.out = (a.astype(np.float64) for a in (net.table, net.recur, net.out))
    x, y = rng.integers(0, 5, (4, 7)), np.array([0, 1, 2, 1])
    x[1, 5:] = 256
    _, grads = net.gradients(x, y)
    for param, grad in zip((net.table, net.recur, net.out), grads):
        places = [tuple(rng.integers(0, n) for n in param.shape) for _ in range(12)]
        if param is net.table:
            places = [(d, int(b), int(k)) for d, b, k in zip(rng.integers(0, 2, 12), rng.choice(x.reshape(-1), 12), rng.integers(0, 9, 12))]
        for at in places:
            keep, e = param[at], 1e-4
            param[at] = keep + e
            up, _ = net.gradients(x, y)
            param[at] = keep - e
            down, _ = net.gradients(x, y)
            param[at] = keep
            # States are kept in single precision, which bounds how well differences can agree.
            assert grad[at] == pytest.approx((up - down) / (2 * e), rel=0.08, abs=5e-4)


def test_fit_equals_numpy_covariances(spark):
    rng = random.Random(8)
    words = ["alpha", "Beta,", "#gamma", "12", "delta.", "épsilon"]
    texts = [(i, "\n".join(" ".join(rng.choice(words[: 3 + i % 4]) for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(1, 6)))) for i in range(160)]
    df = spark.createDataFrame([*texts, (999, None), (998, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(rng.random() < 0.2 + 0.2 * (i % 4))) for i, _ in texts] + [(999, 0), (998, 1), (5000, 1)], "doc_id long, quality int")
    stats = quality_classifier.statistics(df, [F.col("doc_id")])
    rows = {r[0]: list(r)[1:] for r in stats.select("_row.doc_id", *quality_classifier.FEATURES).collect()}
    label = {r[0]: r[1] for r in labels.collect() if r[0] in rows}
    model = quality_classifier.fit(stats, labels, to_pooled=0.3, to_identity=0.05)
    x = {k: np.array([rows[i] for i in label if label[i] == k]) for k in (0, 1)}
    own = {k: np.cov(x[k].T, ddof=1) for k in (0, 1)}
    pooled = sum((len(x[k]) - 1) * own[k] for k in (0, 1)) / (len(label) - 2)
    pooled = 0.95 * pooled + 0.05 * np.trace(pooled) / len(pooled) * np.eye(len(pooled))
    want = {i: 0.0 for i in rows}
    for i, v in rows.items():
        density = []
        for k in (0, 1):
            cov, d = 0.7 * own[k] + 0.3 * pooled, np.array(v) - x[k].mean(0)
            density.append(-0.5 * (d @ np.linalg.solve(cov, d) + np.linalg.slogdet(cov)[1]) + math.log(len(x[k]) / len(label)))
        want[i] = 1 / (1 + math.exp(-max(-700, min(700, density[1] - density[0]))))
    got = {r[0]: r[1] for r in stats.select("_row.doc_id", model.score().alias("s")).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_statistics_equal_plain_counts(spark):
    text = "One two, TWO\n\none two, TWO\nOne two, TWO\n#5 ünd |x|"
    got = spark.createDataFrame([(1, text)], "doc_id long, text string").transform(lambda d: quality_classifier.statistics(d, [F.col("doc_id")])).first()
    words, chars = text.split(), len(text)
    odds = lambda part, whole: math.log((part + 0.5) / (whole - part + 0.5))
    assert got["words"] == pytest.approx(math.log(len(words) + 1)) and got["distinct"] == pytest.approx(odds(len(set(words)), len(words)))
    assert got["symbols"] == pytest.approx(odds(3, chars)) and got["digits"] == pytest.approx(odds(1, chars)) and got["punctuation"] == pytest.approx(odds(3, chars))
    assert got["upper"] == pytest.approx(odds(sum(c.isascii() and c.isupper() for c in text), chars)) and got["repeated_lines"] == pytest.approx(odds(1, 4))
    assert got["other_bytes"] == pytest.approx(odds(1, chars + 1)) and got["line_words"] == pytest.approx(math.log((len(words) + 1) / 5))
