"""Relative links and all links of a page are edges."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from strataq.llm import url_filters


def test_links_resolve_like_a_browser(spark):
    links = ["next.html", "./x", "../y", "../../../z", "?id=1", "/a/./b/../c?q=../d", "a/..", ".", "..", "http://o.io/a#f", "//o.io/p/q", "d/e?u=http://o.io/", "/r?u=http://o.io/"]
    bases = ["http://h.io/p/q/r.html?s=/t/u", "http://h.io/p/"]
    df = spark.createDataFrame([(b, x) for b in bases for x in links], "base string, link string")
    for r in df.withColumn("url", url_filters.resolve(F.col("base"), F.col("link"))).collect():
        assert r["url"] == urljoin(r["base"], r["link"]), r
    odd = spark.createDataFrame([("http://h.io", "x"), ("http://h.io/a", "mailto:a@b.c"), ("http://h.io/a", "#f"), ("nothing", "x.html"), ("http://h.io/a", "http://o.io/a/../b#f")], "base string, link string")
    got = {r["link"]: r["url"] for r in odd.withColumn("url", url_filters.resolve(F.col("base"), F.col("link"))).collect()}
    assert got["x"] == "http://h.io/x" and got["mailto:a@b.c"] is None and got["#f"] is None and got["http://o.io/a/../b#f"] == "http://o.io/b#f"


def test_relative_and_second_links_spread_a_block(spark):
    canonical, refresh = '<link rel="canonical" href="%s">', '<meta http-equiv="refresh" content="0; url=%s">'
    rows = [
        (1, "http://x.org/es/1", canonical % "http://plain.io/d/end"), (2, "http://plain.io/d/e/start", canonical % "../end"), (3, "http://plain.io/d/s2", refresh % "./end"),
        (4, "http://two.io/a", canonical % "http://two.io/b" + canonical % "http://x.org/es/1"), (5, "http://three.io/a", refresh % "/b" + refresh % "http://x.org/es/1"),
        (6, "http://four.io/a", canonical % "b"), (7, "http://five.io/a", None), (8, "nothing", canonical % "x.html"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow"}


def test_pages_of_unclosed_tags_take_time_in_proportion(spark):
    import time

    def seconds(n):
        html = "<link " * (n // 6) + '<link rel=canonical href="https://x.com/a">' + '<meta http-equiv="refresh" content="' + " " * n + ">" + "<base href" + " " * n
        pages = spark.createDataFrame([("https://y.com/", html)], "url string, html string")
        began = time.perf_counter()
        assert [tuple(r) for r in url_filters.links_of(pages).collect()] == [("https://y.com/", "https://x.com/a")]
        return time.perf_counter() - began

    seconds(1000)
    small, large = seconds(1_000_000), seconds(4_000_000)
    assert large < 6 * max(small, 0.5)
