"""Token links by products of incidence matrices, against comparing all byte ranges."""

import functools
import hashlib
from collections import Counter

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from strataq.llm import token_links as L

TEXTS = [
    "The quick brown fox. Ünïcödé und Grüße, naïve café", "", None, " ", "  two  spaces \t\n\n tabs", "<|endoftext|> and <s> </s> <unk>", "日本語のテキスト 🙂🙂", "a" * 3000, "The quick brown fox. Ünïcödé und Grüße, naïve café",
    "low▁line", "x\x00y", "ﬁne ½ ①", "​zero width", "1234567890 " * 40, "the the the the",
]


@pytest.fixture(scope="module")
def tokens():
    return L.Tokenizers(*(open(p, "rb").read() for p in (L.TOKENIZER_A, L.TOKENIZER_B)))


@functools.cache
def other_library():
    found = tokenizers.Tokenizer.from_file(L.TOKENIZER_A)
    found.encode_special_tokens = True
    return found


def test_both_libraries_give_equal_ids_whatever_the_character(tokens):
    for at in range(0, 0x110000, 0x1000):
        text = " ".join(f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2 .{chr(c)}, \n{chr(c)}" for c in range(at, at + 0x1000) if not 0xD800 <= c < 0xE000)
        assert tokens.a.encode_ordinary(text) == other_library().encode(text, add_special_tokens=False).ids


def plain(tokens, text):
    """(a ids, b ids, links as places and overlap, groups as places), by looking at all pairs of tokens."""
    if not text:
        return [], [], [], []
    a, b = other_library().encode(" " + text, add_special_tokens=False).ids, tokens.b.encode(text)
    spans = []
    for ids, of in ((a, tokens.a_bytes), (b, tokens.b_bytes)):
        at, own = 0, []
        for k in ids:
            own.append((at, at + len(of[k])))
            at += len(of[k])
        spans.append(own)
        if b"".join(of[k] for k in ids) != (" " + text).encode():
            return [], [], [], []
    links = [(i, j, min(x[1], y[1]) - max(x[0], y[0])) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if min(x[1], y[1]) > max(x[0], y[0])]
    ends = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
    groups = [([i for i, x in enumerate(spans[0]) if s <= x[0] < e], [j for j, y in enumerate(spans[1]) if s <= y[0] < e]) for s, e in zip([0, *ends], ends)]
    return a, b, links, groups


def test_query_rows_equal_those_by_all_pairs(spark, tokens, monkeypatch):
    rows = [(i, t, "en", 7) for i, t in enumerate(TEXTS)] + [(3, TEXTS[0], "en", 7)]
    found = [plain(tokens, t) for _, t, _, _ in rows]
    assert sum(bool(f[0]) for f in found) >= 9 and not found[9][0]
    count = Counter()
    for a, b, links, _ in found:
        count.update({(a[i], b[j]) for i, j, _ in links})
    best = {k: max(n for (x, _), n in count.items() if x == k) for k, _ in count}
    want = []
    for (doc_id, *_), (a, b, links, groups) in zip(rows, found):
        spelled = ";".join(f"{','.join(str(a[i]) for i in x)}|{','.join(str(b[j]) for j in y)}" for x, y in groups)
        each = [count[a[i], b[j]] for i, j, _ in links]
        n_best = sum(n == best[a[i]] for n, (i, _, _) in zip(each, links))
        want.append((doc_id, len(a), len(b), len(groups), len(links), n_best, sum(each), hashlib.sha256(spelled.encode()).hexdigest() if a else "", sum(len(x) * len(y) for x, y in groups)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_links int").repartition(3)
    keep = [F.col("doc_id"), F.col("n_links")]
    order = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")
    for hot in (1, 20, L.HOT):
        monkeypatch.setattr(L, "HOT", hot)
        got = L.token_links(docs, keep)
        assert got.columns == list(order)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_links_and_shared_groups_of_each_document(spark, tokens):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in L.aligned_tokens(docs, [F.col("doc_id")]).collect():
        a, b, links, groups = plain(tokens, TEXTS[r["doc_id"]])
        assert r["a_ids"] == a and r["b_ids"] == b
        assert [tuple(x) for x in r["links"]] == links
        assert [tuple(x) for x in r["shared"]] == sorted((i, j) for x, y in groups for i in x for j in y)


def test_product_equals_that_of_dense_matrices():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 3, (7, 9)) * (rng.random((7, 9)) < 0.4), rng.integers(0, 3, (5, 9)) * (rng.random((5, 9)) < 0.4)

    def csr(m):
        rows, columns = np.nonzero(m)
        return L.Csr(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(m)))]), columns, m.shape[1], m[rows, columns])

    def dense(c):
        out = np.zeros((c.n_rows, c.n_columns), np.int64)
        out[c.rows(), c.columns] = c.values
        return out

    assert (dense(csr(x).times(csr(y).transposed())) == x @ y.T).all()
    none = csr(np.zeros((0, 9), np.int64))
    assert dense(none.times(csr(y).transposed())).shape == (0, 5)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.token_links(docs, [F.col("doc_id")]).collect() == []
