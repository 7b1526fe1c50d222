"""Rules as a table, and links with entities and bases."""

import random

from pyspark.sql import functions as F

from strataq.llm import url_filters


def test_rules_equal_a_plain_loop(spark):
    rng = random.Random(6)
    labels, bits = ["a", "bb", "c", "de", "org", ""], ["/", "/x", "/x/", "/xy/1", "", "/é"]
    rules = sorted({(rng.choice(["block", "allow"]), ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4))), rng.choice(bits)) for _ in range(60)})
    urls = [(i, f"http://{'.'.join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))}{rng.choice(bits)}{rng.choice(['', '1', '?q', '#f'])}", None) for i in range(400)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge(spark.createDataFrame(urls, "page_id long, url string, html string"), rules=rules).collect()}
    for i, url, _ in urls:
        rest = url.removeprefix("http://")
        cut = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
        host, path = rest[:cut], rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), v == "allow", h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == ((max(fits)[2], "allow" if max(fits)[1] else "block") if fits else (None, "allow")), url


def test_more_rules_than_a_plan_could_hold(spark):
    rules = spark.range(40_000).select(F.lit("block").alias("verdict"), F.concat(F.lit("h"), "id", F.lit(".example")).alias("host"), F.concat(F.lit("/"), F.col("id") % 7).alias("path"))
    pages = spark.range(200).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), F.col("id") * 300, F.lit(".example/"), F.col("id") % 7).alias("url"), F.lit("").alias("html"))
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(pages, rules=rules).collect()}
    assert got == {i: "block" if i * 300 < 40_000 and (i * 300) % 7 == i % 7 else "allow" for i in range(200)}


def test_links_with_entities_and_bases(spark):
    rows = [
        (1, "http://p.io/a", '<link href="http://bad.io/?a=1&amp;b=2" rel=canonical>'), (2, "http://bad.io/?a=1&b=2", "<p>"),
        (3, "http://q.io/a", '<base href="http://bad.io/deep/"><link rel="canonical" href="x.html">'), (4, "http://bad.io/deep/x.html", "<p>"),
        (5, "http://s.io/" + "y" * 5000, '<link rel="canonical" href="http://bad.io/z">'), (6, "http://t.io/", '<base href=""><link rel="canonical" href="u">'),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "path", "_node", "_rule", "component", "suffix", "b_host", "lengths"):
        pages = pages.withColumn(name, F.lit("clash"))
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(pages, rules=[("block", "bad.io", "")]).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow"}
    found = {(r["src"], r["dst"]) for r in url_filters.links_of(pages).collect()}
    assert ("http://q.io/a", "http://bad.io/deep/x.html") in found and ("http://t.io/", "http://t.io/u") in found
