"""URL verdicts by rules, and by redirect equivalence where no rule fits; DataFrame operations alone.

Redirects and all canonical links and refreshes of a page are edges between URLs; relative links are
resolved against the page's base (RFC 3986, 5.2). A URL without a rule takes the decision of
its connected component: block if a member is blocked and none is allowed by a rule, else allow.
Rules are a table of any size, joined on the suffixes of a host and the prefixes of a path that have
a rule. Long URLs and pages are taken whole, in time that grows with their length; a tag with ``<`` in a value is not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.operators.components import connected_components
from strataq.storage import materialize, read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: Tags are cut out first, each from its last ``<`` to the next ``>``; what follows is matched within a tag, without going back over blanks.
TAG = r"""(?i)<(?:link|meta|base)\b[^<>]*+>"""
CANONICAL = r"""(?i)^<link\b(?=[^>]*\brel\s*+=\s*+["']?+canonical\b)[^>]*\bhref\s*+=\s*+["']?+([^"'\s>]++)"""
BASE = r"""(?i)^<base\b[^>]*\bhref\s*+=\s*+["']?+([^"'\s>]++)"""
REFRESH = r"""(?i)^<meta\b(?=[^>]*\bhttp-equiv\s*+=\s*+["']?+refresh\b)[^>]*\bcontent\s*+=\s*+["']?+\s*+[0-9.]*+\s*+;\s*+url\s*+=\s*+["']?+([^"'\s>]++)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """A URL as a graph node: without fragment, host in lower case; null if it has no ``://``."""
    u = F.regexp_replace(url, "(?s)#.*$", "")
    rest = F.regexp_extract(u, "(?s)^.*?://[^/?]*(.*)$", 1)
    return F.when(F.instr(u, "://") > 0, F.concat(F.substring_index(u, "://", 1), F.lit("://"), host_of(u), rest))


#: References that URLs in attributes hold; that of the ampersand comes last.
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#x2F;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def decoded(link: Column) -> Column:
    """An attribute's value with its character references of ENTITIES replaced."""
    for name, char in ENTITIES:
        link = F.replace(link, F.lit(name), F.lit(char))
    return link


def _without_dots(path: Column) -> Column:
    """A path from ``/`` on without dot segments: ``.`` goes, and ``..`` goes with the segment before it."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"),
        lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))),
        lambda a: F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(a) > 0), F.concat(a, F.array(F.lit("")))).otherwise(a),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolve(base: Column, link: Column) -> Column:
    """A link as found in a page as an absolute URL; null for schemes without ``://`` and for fragments of the page."""
    scheme = F.substring_index(base, "://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_extract(path_of(base), "(?s)^.*/", 0)
    url = (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | link.startswith("#"), None)
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path_of(base), link))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )
    path = path_of(url)
    flat = F.concat(F.regexp_extract(url, "(?s)^.*?://[^/?#]*", 0), _without_dots(path), F.regexp_extract(url, "(?s)^.*?://[^?#]*(.*)$", 1))
    return F.when(F.contains(path, F.lit("/.")), flat).otherwise(url)


def _once(value: Column) -> Column:
    """``value`` as a row of its own, which filters and projections above are not merged with."""
    return F.explode(F.array(value))


def links_of(pages: DataFrame) -> DataFrame:
    """(src, dst) nodes of canonical links and of meta refreshes in ``pages`` (url, html)."""
    tags = pages.select("url", F.regexp_extract_all("html", F.lit(TAG), F.lit(0)).alias("tags")).where(F.size("tags") > 0)
    values = lambda pattern: F.filter(F.transform("tags", lambda t: F.regexp_extract(t, pattern, 1)), lambda x: x != "")
    found = tags.select("url", F.coalesce(F.get(values(BASE), 0), F.lit("")).alias("base"), F.explode(F.concat(values(CANONICAL), values(REFRESH))).alias("link"))
    # A step at a time: each value is used many times in the next one's expression, and the planner would put it in at every place.
    found = found.select("url", _once(F.struct(decoded(F.col("base")).alias("base"), decoded(F.col("link")).alias("link"))).alias("x")).select("url", "x.*")
    base = F.when(F.col("base") == "", F.col("url")).otherwise(F.coalesce(resolve(F.col("url"), F.col("base")), F.col("url")))
    found = found.select("url", "link", _once(base).alias("base")).select("url", _once(resolve(F.col("base"), F.col("link"))).alias("to"))
    found = found.select(_once(F.struct(node_of(F.col("url")).alias("src"), node_of(F.col("to")).alias("dst"))).alias("x")).select("x.*")
    return found.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")


def rule_table(spark: SparkSession, rules) -> tuple[DataFrame, DataFrame]:
    """Rules (verdict, host, path), listed or as a table, by host and path, and the lengths of the paths that a host has rules for.

    Both are files, so Spark broadcasts them where its own size check allows, and else joins by host.
    """
    given = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "verdict string, host string, path string")
    one = given.select(F.coalesce("host", F.lit("")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), (F.col("verdict") == "allow").alias("allow"))
    one = materialize(one.groupBy("r_host", "r_path").agg(F.max("allow").alias("allow")), "url-rules")
    lengths = materialize(one.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths")), "url-rule-lengths")
    return one, lengths


def rules_for(urls: DataFrame, rules: tuple[DataFrame, DataFrame]) -> DataFrame:
    """host, path and the longest fitting rule as struct (size, allow, rule), for the (host, path) of ``urls`` that have one; of equal rules allow wins."""
    one, lengths = rules
    parts = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    met = urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    met = met.join(lengths.withColumnRenamed("r_host", "suffix"), "suffix").select("host", "path", "suffix", F.explode("lengths").alias("n"))
    met = met.where("n <= length(path)").withColumn("prefix", F.expr("left(path, n)"))
    met = met.join(one, (F.col("suffix") == F.col("r_host")) & (F.col("prefix") == F.col("r_path")))
    rule = F.concat("r_host", "r_path")
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("size"), "allow", rule.alias("rule"))).alias("_rule"))
    return materialize(best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "_rule"), "url-best-rules")


def _ruled(urls: DataFrame, rules: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``urls`` (host, path) with ``_rule``, null where none fits."""
    best = rules_for(urls, rules)
    return urls.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left").drop("b_host", "b_path")


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url, html).

    ``redirects`` (src, dst) are further edges between URLs; ``rules`` a list or a table of (verdict,
    host, path), whose nulls count as empty. A fitting rule decides alone. A null url
    or one without ``://`` has empty host and path, no aliases and, unless a rule fits, is allowed.
    Repeated rows are judged alike; other columns are ignored; empty tables give no rows.
    """
    table = rule_table(pages.sparkSession, rules)
    found = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("_node"))
    found = _ruled(found, table)
    edges = links_of(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("src")), node_of(F.col("dst"))))
    alias = materialize(connected_components(edges), "url-aliases")
    own = _ruled(alias.select("component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")), table)
    # max over (false, true) of the members' decisions, aggregated before the shuffle; then joined to the members from a file.
    fate = own.where("_rule IS NOT NULL").groupBy("component").agg(F.max(F.col("_rule.allow")).alias("allowed"))
    blocked = fate.where("NOT allowed").select("component")
    blocked_nodes = materialize(alias.join(materialize(blocked, "url-fates"), "component", "left_semi").select(F.col("node").alias("_blocked")), "url-blocked")
    out = found.join(blocked_nodes, (F.col("_node") == F.col("_blocked")) & F.col("_rule").isNull(), "left")
    verdict = F.when(F.col("_rule").isNotNull(), F.when(F.col("_rule.allow"), "allow").otherwise("block")).when(F.col("_blocked").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))


OP6_SQL = r"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
links AS (
  SELECT url, unnest([regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
                      regexp_extract(html, '(?i)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*\brel\s*=\s*["'']?canonical\b', 1),
                      regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\bcontent\s*=\s*["'']?\s*[0-9.]*\s*;\s*url\s*=\s*["'']?([^"''\s>]+)', 1)]) AS link
  FROM pages),
absolute AS (
  SELECT regexp_replace(url, '(?s)#.*$', '') AS s,
         regexp_replace(CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN split_part(url, '://', 1) || ':' || link
              WHEN starts_with(link, '/') THEN split_part(url, '://', 1) || '://' || regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) || link END, '(?s)#.*$', '') AS d
  FROM links WHERE link <> '' AND contains(url, '://')),
norm AS (
  SELECT split_part(s, '://', 1) || '://' || translate(regexp_extract(s, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(s, '(?s)^.*?://[^/?]*(.*)$', 1) AS a,
         split_part(d, '://', 1) || '://' || translate(regexp_extract(d, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(d, '(?s)^.*?://[^/?]*(.*)$', 1) AS b
  FROM absolute WHERE d IS NOT NULL),
edges AS (SELECT a, b FROM norm WHERE a <> b UNION SELECT b, a FROM norm WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
urls AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         split_part(regexp_replace(url, '(?s)#.*$', ''), '://', 1) || '://' || translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(regexp_replace(url, '(?s)#.*$', ''), '(?s)^.*?://[^/?]*(.*)$', 1) AS node
  FROM pages),
parts AS (SELECT DISTINCT b AS node, translate(regexp_extract(b, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(b, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM edges),
fits AS (SELECT node, arg_max(verdict, length(h || p)) AS verdict FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY node),
fate AS (SELECT r.a AS node, bool_or(f.verdict = 'block') AND NOT bool_or(f.verdict = 'allow') AS blocked FROM reach r JOIN fits f ON f.node = r.b GROUP BY r.a)
SELECT u.page_id, u.host, u.path, m.h || m.p AS rule, coalesce(m.verdict, CASE WHEN f.blocked THEN 'block' END, 'allow') AS verdict
FROM urls u
LEFT JOIN LATERAL (SELECT verdict, h, p FROM rules WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p) ORDER BY length(h || p) DESC LIMIT 1) m ON true
LEFT JOIN fate f ON f.node = u.node
"""
