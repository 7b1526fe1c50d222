"""Defined results of the training-data operators on nulls, blanks, repeats, clashing columns and empty tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from strataq.llm import exact_dedup, language_id, mixing, ngram_join, pieces, pii, quality_classifier, quality_rules, url_filters, warc

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [
    (1, "The same text of a few words for all of us", "en", "a", 1, "x"), (2, "The same text of a few words for all of us", "en", "a", 1, "x"),
    (2, "The same text of a few words for all of us", "en", "a", 1, "x"), (3, None, None, None, None, None), (4, "", "en", "b", 0, "y"), (5, " \t\n ", "fr", "b", 3, "z"),
    (6, LONG, "de", "a", 9, None), (None, "no id at all", "en", None, 2, "w"), (7, "Où ▁ est\r\n 日本 😀\u0000 là ?", "fr", "c", 5, "v"), (8, LONG + " end", "de", "a", 9, "u"),
]
EXTRA = "_row string, _t string, _w string, _text string, _digest string, _gone string, _place string, _id string, ids string, n_tokens string, score string, kept string, n_words string, spans string, lang_pred string, digest string, component_id string, n string, tokens string"
LABELS = "doc_id long, quality int, toxic int, text string, score double"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long, more string")
    for name in EXTRA.split(", "):
        df = df.withColumn(name.split()[0], F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def doc_ids():
    return [F.col("doc_id")]


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_dedup(spark, docs, nothing):
    got = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(docs).collect()}
    same = sha(ROWS[0][1])
    assert got[(1, same)] == (2, 3, False) and got[(2, same)] == (2, 3, True)
    assert got[(3, sha(""))] == (4, 2, False) and got[(4, sha(""))] == (4, 2, True)
    assert got[(None, sha("no id at all"))][2]
    assert exact_dedup.exact_duplicates(nothing).count() == 0
    kept = exact_dedup.keep_distinct(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, (2, 4, 5, 6, None, 7, 8)))
    assert exact_dedup.keep_distinct(nothing).count() == 0


def test_digest_index_keeps_earlier_batches(spark, tmp_path):
    batch = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 3)
    index.ingest(batch((1, "a"), (2, "b"))).count()
    got = {r["doc_id"]: r["keep_id"] for r in index.ingest(batch((9, "a"), (8, "c"))).collect()}
    assert got == {9: 1, 8: 8} and index.table().count() == 3
    index.close()
    again = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 3)
    assert {r["doc_id"]: r["keep_id"] for r in again.ingest(batch((7, "c"))).collect()} == {7: 8}
    assert "Exchange hashpartitioning(digest" not in again.table().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    again.close()


def brute_components(rows, width, num, den):
    sets = {}
    for d, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)} if len(ws) >= width else ({tuple(ws)} if ws else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                i = len(sets[a] & sets[b])
                if den * i >= num * (len(sets[a]) + len(sets[b]) - i) and find(a) != find(b):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("width,num,den", [(4, 85, 100), (5, 4, 5), (2, 1, 2)])
def test_ngram_components_equal_all_pairs(spark, width, num, den):
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, shared = [], [rng.choice(vocabulary) for _ in range(30)]
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 90))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(words)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy + (shared if rng.random() < 0.3 else [])).title()))
    rows += [(len(rows), "one two"), (len(rows) + 1, "ONE  two"), (len(rows) + 2, ""), (len(rows) + 3, None)]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), width, (num, den))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows, width, num, den)


def test_ngram_join_edges(docs, nothing):
    got = ngram_join.ngram_components(docs).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[2] == 1 and by[3] == 3 and by[4] == 4 and by[5] == 5 and by[8] == 6 and by[None] is None
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, (1, 3, 4, 5, 6, None, 7)))
    assert ngram_join.ngram_components(nothing).count() == 0 and ngram_join.keep_one(nothing).count() == 0


def test_pieces_equal_the_library_and_decode(spark, docs, nothing):
    import sentencepiece

    proto = open(pieces.MODEL, "rb").read()
    p, sp = pieces.load(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    texts = ["", " ", "  two  spaces\n\nlines\ttabs ", "naïve café 日本 😀", "x" * 200, "lead and trail ", LONG[:5000]]
    ids, starts = pieces.encode_batch(p, texts, list(range(len(texts))), 1, 0.0)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [sp.encode(t) for t in texts]
    odd = [*texts, "▁ literal ▁▁", "nul\0byte"]
    other = [pieces.encode_batch(p, odd, [7] * len(odd), seed, 0.3) for seed in (1, 1, 2)]
    assert (other[0][0] == other[1][0]).all() and len(other[0][0]) != len(other[2][0])
    for e in other:
        assert pieces.decode_batch(p, *e) == [t.encode() for t in odd]
    out = pieces.encode_documents(docs, [F.col(c) for c in docs.columns]).collect()
    assert all(r["lossless"] for r in out) and len(out) == len(ROWS) and {r["more"] for r in out} == {r[5] for r in ROWS}
    assert {r["doc_id"]: r["n_tokens"] for r in out if r["doc_id"] in (3, 4)} == {3: 0, 4: 0}
    assert pieces.encode_documents(nothing, doc_ids()).count() == 0


def test_heap_and_matrix_merge_alike():
    p = pieces.load(open(pieces.MODEL, "rb").read())
    points, first, _ = pieces._units([LONG[:3000], "Grüße an Ünïcode und 日本語 \U0001f600 abc"])
    import numpy as np

    sizes = np.diff(np.append(first, len(points)))
    key = pieces._keys(pieces._unit_hashes(points, first, sizes), 5, np.arange(len(first)) % 8)
    flat, counts = pieces.segment(p, points, first, sizes, key, 0.4)
    starts = np.cumsum(counts) - counts
    for i in range(len(first)):
        unit = points[first[i] : first[i] + sizes[i]].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        assert pieces._expand(p, unit, pieces.merge_one(p, unit, key[i : i + 1], 0.4)) == flat[starts[i] : starts[i] + counts[i]].tolist()


def brute_pii(t):
    spans = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    spans += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(d))) % 10 == 0:
            spans.append((m.start(), 2, m.end(), "card"))
    spans += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, a, b) for a, _, b, k in sorted(spans)]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(11)
    bits = ["a.b@c.de", "x@y", "@", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 010-9999", "+12", " ", "-", "7", "é", "..", "a@b.c@d.e", "00001.2.3.4", "\n"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 9)))
        assert pii.base_spans(t)[0] == brute_pii(t), t


def test_pii_edges(docs, nothing, spark):
    got = pii.find_pii(docs, [F.col(c) for c in docs.columns]).collect()
    assert len(got) == len(ROWS) and all(r["spans"] == "" and r["base_sha256"] == sha("") for r in got)
    assert pii.find_pii(nothing, doc_ids()).count() == 0
    rows = [(i, f"write to me{i}@mail.example.com or call +1 (555) 010-{1000 + i}, token = \"{sha(str(i))}\"") for i in range(30)]
    out = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), doc_ids()).collect()
    assert all((r["n_email"], r["n_phone"]) == (1, 1) and "secret:" in r["spans"] for r in out)


def test_warc_round_trip_pushes_predicates_down(spark, tmp_path):
    html = "<p>" + "x" * 200 + "</p>"
    rows = [(1, "http://a/", html), (2, "http://b/", html), (3, None, None), (4, "http://d/\r\nX: y", "short"), (5, "http://e/", "short"), (None, "http://f/", "ü" * 90), (7, "http://g/", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("first", F.lit(1))
    path = f"file://{tmp_path}/w"
    warc.archive(pages, path)
    got = {r["page_id"]: r for r in warc.describe(spark, path).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("response", None), 5: ("response", None), None: ("response", None), 7: ("response", None)}
    for i, _, h in rows:
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len((h or "").encode()), sha(h))
    df = warc.read_warc(spark, path)
    assert df.where(F.col("target_uri") == "http://d/\r\nX: y").count() == 1
    plan = df.where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (record_type" not in plan and "Filter ((record_type" not in plan.replace("isnotnull(record_type#", "")
    empty = f"file://{tmp_path}/e"
    warc.archive(pages.limit(0), empty)
    assert warc.describe(spark, empty).count() == 0


def test_url_verdicts_follow_redirects(spark):
    page = lambda i, url, link="": (i, url, f'<link rel="canonical" href="{link}">' if link else "<p>")
    rows = [
        page(1, "http://x.org/es/1"), page(2, "http://plain.io/a", "http://x.org/es/1"), page(3, "http://plain.io/b#f", "http://plain.io/a"), page(4, "http://q.net/de/80"), page(5, "http://z.example.net/de/80"),
        page(6, "http://Sub.Example.COM/en/77?x", ""), page(7, None), page(8, "nothing"), page(9, "http://both.io/", "http://x.org/es/1"), page(10, "http://m.io/", "http://n.io/"), page(11, "http://com/en/"),
        (12, "http://r.io/x", '<meta http-equiv="refresh" content="0; url=//x.org/es/9">'),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filters.judge(pages.union(pages.where("page_id = 1"))).collect()}
    verdict = {k: (r["rule"], r["verdict"]) for k, r in got.items()}
    assert verdict[1] == ("org/es/", "block") and verdict[2] == (None, "block") and verdict[3] == (None, "block") and verdict[12] == (None, "block")
    assert verdict[4] == ("net/de/", "allow") and verdict[5] == ("example.net/de/8", "block") and verdict[6] == ("example.com/en/7", "allow")
    assert verdict[7] == verdict[8] == (None, "allow") and (got[8]["host"], got[8]["path"]) == ("", "") and verdict[10] == (None, "allow") and verdict[11] == ("com/en/", "block")
    more = spark.createDataFrame([("http://m.io/", "http://x.org/es/1"), ("http://m.io/", "http://ok.net/de/1")], "src string, dst string")
    assert {r["page_id"]: r["verdict"] for r in url_filters.judge(pages, more).collect()}[10] == "allow"
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_edf_keeps_every_prefix_within_a_block():
    rng = random.Random(2)
    for _ in range(40):
        parts = [rng.randrange(1, 12) for _ in range(rng.randrange(1, 8))]
        total, done = sum(parts), [0] * len(parts)
        for t, s in enumerate(mixing.edf_period(parts), 1):
            done[s] += 1
            assert all(abs(d - p * t / total) < 1 for d, p in zip(done, parts))
        assert done == parts


def test_mixing_edges(spark, docs, nothing):
    out = mixing.mix(docs, {"a": 2}, block_chars=50_000, bucket_rows=2).collect()
    assert len(out) == len(ROWS) and {r["source"] for r in out} == {"a", "b", "c", ""}
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    taken = {}
    for r in out:
        assert taken.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
    assert mixing.mix(nothing, {}).count() == 0
    mixed = mixing.mixed_order(docs)
    assert mixed.columns == docs.columns and mixed.count() == len(ROWS) and mixing.mixed_order(nothing).count() == 0


def test_mixing_offsets_are_prefix_sums(spark):
    rows = [(i, "x" * (i % 37), f"s{i % 3}") for i in range(500)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), {}, block_chars=100, bucket_rows=16).collect()
    for s in ("s0", "s1", "s2"):
        mine = sorted((r["block"] * 100 + r["block_offset"], r["doc_id"]) for r in out if r["source"] == s)
        at = 0
        for start, i in mine:
            assert start == at
            at += i % 37 + 1


def test_discriminant_equals_numpy_and_edges(spark, docs, nothing):
    import numpy as np

    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "gamma,", "Delta."]) for _ in range(rng.randrange(5, 40))) if i % 3 else "junk " * rng.randrange(5, 40)) for i in range(120)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0, "x", 0.0) for i, _ in texts] + [(1, 5, 0, "x", 0.0), (None, 1, 0, "x", 0.0)], LABELS)
    stats = quality_classifier.statistics(df, doc_ids())
    model = quality_classifier.fit(stats, labels)
    rows = stats.select("_row.doc_id", *quality_classifier.FEATURES, model.score().alias("s")).collect()
    odds = model.log_odds(np.array([list(r)[1:-1] for r in rows], float))
    assert [r["s"] for r in rows] == pytest.approx(list(1 / (1 + np.exp(-np.clip(odds, -700, 700)))), abs=1e-9)
    assert sum((r["s"] >= 0.7) == (r["doc_id"] % 3 > 0) for r in rows) >= 118
    out = quality_classifier.score_quality(docs, labels.limit(0), [F.col(c) for c in docs.columns])
    assert out.count() == len(ROWS) and {r["score"] for r in out.select("score").collect()} == {1.0}
    assert quality_classifier.keep_good(docs, labels).columns == docs.columns
    assert quality_classifier.score_quality(nothing, labels, doc_ids()).count() == 0


def test_rules_equal_a_plain_model(spark, docs, nothing):
    from collections import Counter

    rng = random.Random(9)
    texts = [(i, "".join(rng.choice(["a ", "b ", "c#", "d\n", "e\te ", " the", "|"]) for _ in range(rng.randrange(0, 160))) * rng.randrange(1, 3)) for i in range(150)]
    out = {r["doc_id"]: r for r in quality_rules.apply_rules(spark.createDataFrame(texts, "doc_id long, text string").withColumn("lang", F.lit("en")), doc_ids()).collect()}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows, covered = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), set()
        for k in range(len(w) - 7):
            if windows[tuple(w[k : k + 8])] > 1:
                covered.update(range(k, k + 8))
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w))
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["base_failed"] and r["kept"])
    edge = quality_rules.apply_rules(docs, [F.col(c) for c in docs.columns])
    assert edge.count() == len(ROWS) and edge.columns.count("n_words") == 1 and quality_rules.apply_rules(nothing, doc_ids()).count() == 0


def test_divergence_is_zero_for_equal_shares_and_one_for_disjoint(spark):
    d = lambda counts, q: spark.range(1).select(quality_rules._distance(F.array(*(F.lit(c).cast("long") for c in counts)), q)).first()[0]
    assert d([2, 2], [0.5, 0.5]) == pytest.approx(0) and d([3, 0], [0.0, 1.0]) == pytest.approx(1) and d([0, 0], [0.5, 0.5]) >= 0


def test_language_network_learns_and_edges(spark, docs, nothing):
    import numpy as np

    rng = random.Random(1)
    word = {"xx": ["aba", "caca", "dad"], "yy": ["zuz", "wow", "vuvu"]}
    rows = [(i, " ".join(rng.choice(word[k]) for _ in range(60)), k) for i in range(240) for k in [("xx", "yy")[i % 2]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.fit(df, per_lang=60, windows=2, hidden=4, steps=80, batch=64)
    out = {r["doc_id"]: r for r in language_id.identify(df, doc_ids(), net).collect()}
    held = [i for i, _, _ in rows if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert sum(out[i]["lang_pred"] == rows[i][2] for i in held) >= 0.98 * len(held) and all(0 <= r["score"] <= 1 for r in out.values())
    edge = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, [F.col(c) for c in docs.columns], net).collect()}
    assert edge[3] == edge[4] == edge[5] == ("und", 0.0) and edge[6][0] in ("xx", "yy")
    assert language_id.identify(nothing, doc_ids(), net).count() == 0 and language_id.fit(nothing) is None
    assert {r["lang_pred"] for r in language_id.identify(docs, doc_ids(), None).collect()} == {"und"}
    y = np.array([0, 1])
    net = language_id.Network.start(["xx", "yy"], 3, 2)
    net.table, net.recur, net.out = (a.astype(np.float64) for a in (net.table, net.recur, net.out))
    batch = np.array([[1, 2, 3, 4], [9, 8, 7, 6]])
    _, (_, d_recur, d_out) = net.gradients(batch, y)
    for param, grad, at in ((net.recur, d_recur, (1, 0, 2)), (net.out, d_out, (1, 0))):
        keep, e = param[at], 1e-3
        param[at] = keep + e
        up, _ = net.gradients(batch, y)
        param[at] = keep - e
        down, _ = net.gradients(batch, y)
        param[at] = keep
        assert grad[at] == pytest.approx((up - down) / (2 * e), rel=0.05, abs=1e-4)
