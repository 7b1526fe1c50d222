"""Phrases counted in FM-indexes of shards, against counting them one by one."""

import zlib
from collections import Counter
from fractions import Fraction

import numpy as np

from strataq.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for end in ".,;:!?\n\x0b\x0c\r":
        text = text.replace(end, "\n")
    return [[w for w in p.replace("\t", " ").split(" ") if w] for p in text.translate(LOWER).split("\n")]


def brute(rows, max_words, min_count, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for p in pieces(text or ""):
            n[lang or "und"] += len(p)
            for m in range(1, max_words + 1):
                for i in range(len(p) - m + 1):
                    f[lang or "und", tuple(p[i : i + m])] += 1
    f = {k: v for k, v in f.items() if v >= min_count}
    holds = lambda long, p: any(long[i : i + len(p)] == p for i in range(len(long) - len(p) + 1))
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or any(k[0] == lang and len(k[1]) > len(p) and holds(k[1], p) and 100 * v >= 80 * a for k, v in f.items()):
            continue
        cuts = [(int(Fraction(2000000 * a, f[lang, p[:k]] + f[lang, p[k:]])), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:top], 1))


def random_rows(seed, n):
    rng = np.random.default_rng(seed)
    words = ["a", "B", "b", "cé", "ÉC", "d\x00", "<s>", " "]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " "], p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05]) for _ in range(rng.integers(0, 60)))
    return [(rng.choice(["en", "de", None]), text()) for _ in range(n)] + [("en", None), ("en", ""), ("fr", " .. \t"), (None, "a b " * 40)]


def result(spark, rows, **more):
    docs = spark.createDataFrame([(i, lang if lang is None else str(lang), t, "x", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, f int")
    return sorted(tuple(r) for r in C.collocations(docs.repartition(3), **more).collect())


def test_shards_of_any_size_give_the_counts_of_all_texts(spark):
    rows = random_rows(1, 60)
    want = brute(rows, 4, 3, 50)
    assert len(want) > 50
    for shard_words in (10, 200, C.SHARD):
        assert result(spark, rows, min_count=3, top=50, shard_words=shard_words) == want


def test_pairs_only_and_empty_tables(spark):
    rows = random_rows(2, 30)
    assert result(spark, rows, max_words=2, min_count=2, top=9) == brute(rows, 2, 2, 9)
    assert result(spark, rows[:0], min_count=2) == []
    assert result(spark, [("en", None), (None, "")], min_count=1) == []


def test_arithmetic_passes_64_bits(spark):
    counted = spark.createDataFrame([(4 * 10**18, 5 * 10**18, 6 * 10**18)], "a long, l long, r long")
    score = counted.selectExpr("(cast(a as decimal(38,0)) * 2000000) div (cast(l as decimal(38,0)) + r) AS s").first()["s"]
    assert score == 2000000 * 4 * 10**18 // (11 * 10**18)


def test_extensions_of_a_phrase_are_the_most_frequent_longer_ones(spark):
    docs = spark.createDataFrame([("en", "x a b y. x a b. z a b y. a b")], "lang string, text string")
    got = {r["phrase"]: (r["f"], r["left_f"], r["right_f"]) for r in C.phrase_counts(docs, min_count=1)[0].collect()}
    assert got["a b"] == (4, 2, 2) and got["x a"] == (2, 0, 2) and got["b"] == (4, 4, 2) and got["x a b y"] == (1, 0, 0)


def test_intervals_stay_in_step_in_both_directions(monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 50)
    rng = np.random.default_rng(5)
    ids = np.concatenate([[0], rng.integers(0, 5, 400), [0]]).astype(np.int32)
    hashes = np.arange(1, 6, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    index = C.FMIndex.of(ids, hashes)
    assert index.counts.tolist() == np.bincount(ids, minlength=5).tolist()
    for sides in ((True, True, True), (False, False, False), (False, True, False), (True, False, True)):
        p = index.words()
        for m, left in enumerate(sides, 2):
            p = index.extend(p, left)
            want = Counter(tuple(ids[i : i + m]) for i in range(len(ids) - m + 1) if 0 not in ids[i : i + m])
            assert {tuple(w): c for w, c in zip(p.words.tolist(), p.count.tolist())} == want


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "Ab  c,d\te.f " * 50
    whole = [w for part in C.words_of(text) for w in part]
    monkeypatch.setattr(C, "SLICE", 7)
    assert [w for part in C.words_of(text) for w in part] == whole == [b"ab", b"c", b"\n", b"d", b"e", b"\n", b"f"] * 50


def test_counts_of_cells_survive_their_coding(monkeypatch):
    monkeypatch.setattr(C, "HELD", 100)
    rng = np.random.default_rng(4)
    want, parts = Counter(), []
    for _ in range(5):
        counts = C._Counts(300)
        for _ in range(6):
            cells = np.unique(rng.integers(0, 1 << 18, 60) * rng.integers(0, 200, 60) % (1 << C.FILTER_BITS))
            n = rng.integers(1, 200, len(cells))
            counts.add(cells, n)
            want.update(dict(zip(cells.tolist(), n.tolist())))
        parts += list(counts.blocks())
    cells, n = C._Counts(300).read(iter(parts)).summed()
    assert dict(zip(cells.tolist(), n.tolist())) == {k: min(v, 300) for k, v in want.items()}


def test_spelled_phrases_move_in_small_blocks_and_keep_their_counts(monkeypatch):
    monkeypatch.setattr(C, "SPELLED", 1000)
    rng = np.random.default_rng(6)
    want, blocks = Counter(), []
    for _ in range(3):
        spelled = C._Spelled()
        for _ in range(4):
            keys = sorted({"en\r\n" + " ".join(f"wörd{k}" for k in rng.integers(0, 12, rng.integers(1, 5))) for _ in range(900)})
            f = rng.integers(1, 1 << 40, len(keys))
            spelled.add(C.pa.array([zlib.crc32(k.split(" ")[0].encode()) % 4 for k in keys]), C.pa.array(keys, C.pa.large_string()), C.pa.array(f))
            want.update(dict(zip(keys, f.tolist())))
        blocks += list(spelled.blocks())
    read = C._Spelled()
    for b in blocks:
        read.read(b["bucket"][0].as_py(), b["n"][0].as_py(), b["phrases"][0].as_buffer())
    rows = read.summed()
    assert dict(zip(rows["key"].to_pylist(), rows["f"].to_pylist())) == want
    # A row with its words took 19 bytes and more in the shuffle.
    assert sum(len(b["phrases"][0].as_py()) for b in blocks) < 16 * sum(b["n"][0].as_py() for b in blocks)
    assert list(C._Spelled().blocks()) == []


def test_many_cells_are_not_sorted_again_at_every_turn(monkeypatch):
    monkeypatch.setattr(C, "HELD", 100)
    sums, summed = [], C._Counts.summed
    monkeypatch.setattr(C._Counts, "summed", lambda self: sums.append(1) or summed(self))
    counts = C._Counts(30)
    for k in range(200):
        counts.add(np.arange(k * 50, k * 50 + 50), np.ones(50, np.int64))
    assert len(counts.summed()[0]) == 10000 and len(sums) < 15 and counts.full()


def test_hashes_of_words_are_those_of_their_bytes_and_language():
    data, ends = C._dictionary("a\nbé\nab\n\x00".encode())
    got = C._hashes("en", data, ends)
    assert got[0] == 0 and len(set(got.tolist())) == 5 and got[3] == C._hashes("en", *C._dictionary(b"ab"))[1] != C._hashes("de", *C._dictionary(b"ab"))[1]
    assert C._hashes("en", *C._dictionary(b"")).tolist() == [0]
