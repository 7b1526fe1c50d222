"""Added spans against planted ones, reliabilities against plain ones, and a classifier that can overrule the votes."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from strataq.llm import pii


def iban(rng):
    body = "".join(rng.choice("0123456789") for _ in range(18))
    digits = lambda s: "".join(str(int(c, 36)) for c in s)
    return f"DE{98 - int(digits(body + 'DE00')) % 97:02d}{body}"


def planted(seed, n):
    """Texts with the personal spans in them and spans that only look alike."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    good = [
        lambda: ("loose_email", "contact ", f"{word()} at {word()} dot com"), lambda: ("loose_email", "mail me: ", f"{word()} [at] {word()} [dot] org"),
        lambda: ("loose_phone", "call ", f"{rng.randrange(200, 999)}-{d(3)}-{d(4)}"), lambda: ("loose_phone", "tel ", f"({rng.randrange(200, 999)}) {d(3)}-{d(4)}"),
        lambda: ("national_id", "ssn ", f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"), lambda: ("iban", "iban ", iban(rng)),
        lambda: ("secret", "api_key=", "".join(rng.choice("abcdef0123456789") for _ in range(32))), lambda: ("secret", "the key is ", "AKIA" + "".join(rng.choice("ABCDEFGHIJ234567") for _ in range(16))),
    ]
    bad = [
        lambda: ("iban", "order ", f"DE{d(2)}{d(18)}"), lambda: ("loose_ip", "version ", f"1.{d(1)}.{rng.randrange(300, 999)}.{d(1)}"),
        lambda: ("secret", "token: ", rng.choice(["economy", "parliament", "standard", "together"])), lambda: ("national_id", "section ", f"000-{d(2)}-{d(4)}"),
        lambda: ("loose_card", "total ", "1" + d(14)),
    ]
    rows, truth = [], set()
    for i in range(n):
        text = ""
        for _ in range(rng.randrange(1, 5)):
            real = rng.random() < 0.6
            kind, cue, value = rng.choice(good if real else bad)()
            text += " ".join(word() for _ in range(rng.randrange(2, 9))) + ". " + cue
            if real:
                truth.add((i, kind, len(text), len(text) + len(value)))
            text += value + " . "
        rows.append((i, text))
    return rows, truth


def added(df):
    return {(r["doc_id"], k, int(a), int(b)) for r in df.collect() for k, a, b in (s.split(":") for s in r["spans"].split(",") if s) if k not in pii.BASE}


def test_recall_and_precision_of_added_spans(spark):
    rows, truth = planted(4, 500)
    got = added(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), [F.col("doc_id")]))
    recall, precision = len(got & truth) / len(truth), len(got & truth) / len(got)
    print(f"recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.9 and precision >= 0.9


def test_reliabilities_come_back():
    """Cells drawn from known reliabilities: posteriors are those of the truth that made them."""
    rng = np.random.default_rng(2)
    right = (0.95, 0.8, 0.7, 0.9)
    counts, good = {}, {}
    for _ in range(20_000):
        z = rng.random() < 0.5
        v = tuple((1 if z else -1) * (1 if rng.random() < p else -1) for p in right)
        c = pii.cell("iban", v, 22)
        counts[c] = counts.get(c, 0) + 1
        good[c] = good.get(c, 0) + z
    post = pii.estimate(counts)
    for c, n in counts.items():
        if n > 200:
            assert abs(post[c] - good[c] / n) < 0.1


def test_words_beside_a_span_overrule_the_votes():
    """Votes with a posterior of 0.6 and, at other candidates, a word of clear negatives: where both meet, as no drawn candidate shows, the word decides."""
    cue, other = pii.zlib.crc32(b"before lottery") >> 19, pii.zlib.crc32(b"before phone") >> 19
    rows = [[1, other]] * 120 + [[2, cue]] * 400 + [[3, other]] * 400
    y = np.array([0.6] * 120 + [0.05] * 400 + [0.95] * 400)
    model = pii.Spotter.train(rows, y, np.ones(len(rows)))
    low, high = model.odds(np.array([1, cue, 1, other]), np.array([0, 2, 4]))
    assert low < 0 < high


def test_equal_texts_are_judged_alike_and_a_tiny_sample_is_enough(spark):
    rows, truth = planted(9, 60)
    twice = rows + [(1000 + i, t) for i, t in rows]
    out = pii.find_pii(spark.createDataFrame(twice, "doc_id long, text string"), [F.col("doc_id")], sample=20)
    by = {r["doc_id"]: (r["spans"], r["n_spans"]) for r in out.collect()}
    assert all(by[i] == by[1000 + i] for i, _ in rows)
    assert all(n == len(re.findall(":", s)) // 2 for s, n in by.values())


def test_long_values_are_taken_whole():
    secret, local, label = "a1B2" * 75, "first.last" * 8, "sub-domain" * 9
    text = f"token={secret} and {local} [at] {label} [dot] {label} [dot] a [dot] b [dot] c [dot] d [dot] org end"
    spans = {k: text[a:b] for k, a, b in pii.candidates(text)}
    assert spans["secret"] == secret
    assert spans["loose_email"] == f"{local} [at] {label} [dot] {label} [dot] a [dot] b [dot] c [dot] d [dot] org"


def test_long_runs_take_linear_time():
    import time

    def seconds(n):
        began = time.perf_counter()
        pii.candidates("x" * n + " dot token=" + "y" * n + " a at b dot " * (n // 20))
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(2_000_000) < 8 * max(seconds(500_000), 0.02)
