"""Queries on graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.functions import text as X
from strataq.operators import graph as G
from strataq.operators.folds import numeric_confidence
from strataq.plans import tables as T
from strataq.plans.tables import FINDINGS_SQL
from strataq.queries.base import query
from strataq.storage import read_table

_NUM = "CASE confidence WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.6 ELSE 0.3 END::DOUBLE"


@query(
    "chain_confidence",
    f"""WITH RECURSIVE {FINDINGS_SQL}, n AS (SELECT id, derived_from, {_NUM} AS numeric, record_type FROM findings),
    w AS (SELECT id, id AS root, derived_from AS next, numeric AS p, record_type AS t, 0 AS length FROM n UNION ALL SELECT w.id, n.id, n.derived_from, w.p * n.numeric, n.record_type, w.length + 1 FROM w JOIN n ON w.next = n.id WHERE w.length < 5)
    SELECT id, root, length, confidence, grounded FROM (SELECT id, root, length, round(p, 6) AS confidence, t = 'observed' AS grounded, row_number() OVER (PARTITION BY id ORDER BY length DESC) AS r FROM w) WHERE r = 1""",
)
def chain_confidence(spark, sf):
    return G.chain(T.findings(spark, sf).select("id", "derived_from", numeric_confidence(F.col("confidence")).alias("numeric"), "record_type"))


_MENTIONS = "SELECT 'f' || doc_id AS node, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_.%+-]+@[A-Za-z0-9_.-]+[.][A-Za-z]{2,}'))) AS entity FROM documents"


@query(
    "contamination_ids",
    f"""WITH RECURSIVE {FINDINGS_SQL}, seeds AS (SELECT 'f' || doc_id AS node FROM labels WHERE toxic = 1), m AS ({_MENTIONS}),
    anchors AS (SELECT node FROM seeds UNION SELECT a.node FROM m a JOIN m b USING (entity) JOIN seeds s ON s.node = b.node), c AS (SELECT node FROM anchors UNION SELECT f.id FROM c JOIN findings f ON f.derived_from = c.node) SELECT node FROM c""",
)
def contamination_ids(spark, sf):
    seeds = read_table(spark, sf, "labels").where("toxic = 1").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("node"))
    found = T.findings(spark, sf)
    mail = F.array_distinct(F.regexp_extract_all("text", F.lit(X.EMAIL), F.lit(0)))
    mentions = found.select(F.col("id").alias("node"), F.explode(mail).alias("entity"))
    parents = found.where("derived_from IS NOT NULL").select(F.col("id").alias("child"), F.col("derived_from").alias("parent"))
    return G.contamination(seeds, mentions, parents).select("node")


_REF = "r AS (SELECT DISTINCT l_orderkey AS finding, l_partkey AS symbol, l_orderkey % 40 AS investigation FROM lineitem)"


def _references(spark, sf):
    return T.refers_to(spark, sf).withColumn("investigation", F.col("finding") % 40)


def _symbols(spark, sf):
    return read_table(spark, sf, "part").select(F.col("p_partkey").alias("symbol"))


@query("blast_radius", f"WITH {_REF}, c AS (SELECT symbol, count(DISTINCT finding) AS findings, count(DISTINCT investigation) AS investigations FROM r GROUP BY 1), t AS (SELECT a.symbol, count(DISTINCT b.symbol) AS co FROM r a JOIN r b ON a.finding = b.finding AND a.symbol <> b.symbol GROUP BY 1) SELECT c.symbol, findings, investigations, coalesce(co, 0) AS co_referenced FROM c LEFT JOIN t ON c.symbol = t.symbol WHERE c.symbol IN (SELECT p_partkey FROM part)")
def blast_radius(spark, sf):
    return G.impact(_references(spark, sf), _symbols(spark, sf))


@query("co_referenced", f"WITH {_REF} SELECT symbol, other, shared, place FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY shared DESC, other) AS place FROM (SELECT a.symbol, b.symbol AS other, count(DISTINCT a.finding) AS shared FROM r a JOIN r b ON a.finding = b.finding AND a.symbol <> b.symbol GROUP BY 1, 2)) WHERE place <= 8")
def co_referenced(spark, sf):
    return G.co_referenced(_references(spark, sf), _symbols(spark, sf))


@query(
    "bfs_subgraph",
    """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS src, -l_partkey - 1 AS dst FROM lineitem), b AS (SELECT src AS a, dst AS z FROM e UNION SELECT dst, src FROM e),
    h0 AS (SELECT 0::BIGINT AS node), h1 AS (SELECT DISTINCT z AS node FROM b WHERE a IN (SELECT node FROM h0) AND z NOT IN (SELECT node FROM h0)), h2 AS (SELECT DISTINCT z AS node FROM b WHERE a IN (SELECT node FROM h1) AND z NOT IN (SELECT node FROM h0 UNION SELECT node FROM h1))
    SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""",
)
def bfs_subgraph(spark, sf):
    edges = T.refers_to(spark, sf).select(F.col("finding").alias("src"), (-F.col("symbol") - 1).alias("dst"))
    return G.neighbourhood(spark.range(1).select(F.col("id").alias("node")), edges, 2)[0]


_ACTIVE_SQL = """WITH e AS (SELECT l_orderkey AS src, -l_partkey - 1 AS dst, 0.4::DOUBLE + (l_linenumber % 7)::DOUBLE / 10 AS weight, CASE l_linenumber % 4 WHEN 0 THEN 'caused_by' WHEN 1 THEN 'updated_by' WHEN 2 THEN 'contradicts' ELSE 'semantic_link' END AS kind FROM lineitem),
    u AS (SELECT src, dst, least(1, (weight - 0.4::DOUBLE) / (1 - 0.4::DOUBLE) * CASE kind WHEN 'caused_by' THEN 1.3::DOUBLE WHEN 'updated_by' THEN 1.2::DOUBLE ELSE 1 END) AS w FROM e WHERE weight >= 0.4::DOUBLE AND kind <> 'contradicts'),
    d AS (SELECT src, count(*) AS degree FROM u GROUP BY 1) SELECT dst AS node, round(least(1, sum(w / degree)), 6) AS activation FROM u JOIN d USING (src) GROUP BY 1HAVING round(least(1, sum(w / degree)), 6) >= 0.5"""


@query("spread_activation", _ACTIVE_SQL)
def spread_activation(spark, sf):
    kind = F.when(F.col("l_linenumber") % 4 == 0, "caused_by").when(F.col("l_linenumber") % 4 == 1, "updated_by").when(F.col("l_linenumber") % 4 == 2, "contradicts").otherwise("semantic_link")
    edges = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), (-F.col("l_partkey") - 1).alias("dst"), (F.lit(0.4) + (F.col("l_linenumber") % 7).cast("double") / 10).alias("weight"), kind.alias("kind"))
    seeds = edges.select(F.col("src").alias("node")).distinct().withColumn("activation", F.lit(1.0))
    return G.spread(seeds, edges, threshold=0.4999995).select("node", F.round("activation", 6).alias("activation"))


@query("hybrid_activation", f"WITH a AS ({_ACTIVE_SQL}), b AS (SELECT * FROM a ORDER BY activation DESC, node LIMIT 50), h AS (SELECT node, activation, round(0.7::DOUBLE * coalesce((p_size % 10)::DOUBLE / 10, 0) + 0.3::DOUBLE * activation, 6) AS hybrid FROM b LEFT JOIN part ON node = -p_partkey - 1 AND p_size % 3 > 0) SELECT *, row_number() OVER (ORDER BY hybrid DESC, node) AS place FROM h")
def hybrid_activation(spark, sf):
    """The most active symbols in the order of their own score and their activation; some symbols have no score."""
    scores = read_table(spark, sf, "part").where("p_size % 3 > 0").select((-F.col("p_partkey") - 1).alias("node"), ((F.col("p_size") % 10).cast("double") / 10).alias("score"))
    return G.activated(spread_activation(spark, sf), scores, 50)


@query("innermost_span", "WITH s AS (SELECT conv_id AS file, min(turn) AS start, max(turn) AS \"end\", 'c' || conv_id AS span FROM conversations GROUP BY 1 UNION ALL SELECT conv_id, turn, turn + 1, 'u' || conv_id || '_' || turn FROM conversations WHERE role = 'user') SELECT c.conv_id || ':' || c.turn AS point, arg_max(s.span, (s.start, -s.\"end\", s.span)) AS span FROM conversations c JOIN s ON s.file = c.conv_id AND c.turn BETWEEN s.start AND s.\"end\" GROUP BY 1")
def innermost_span(spark, sf):
    c = read_table(spark, sf, "conversations")
    name = F.col("conv_id").cast("string")
    spans = c.groupBy(F.col("conv_id").alias("file")).agg(F.min("turn").alias("start"), F.max("turn").alias("end")).withColumn("span", F.concat(F.lit("c"), F.col("file").cast("string")))
    user = c.where("role = 'user'").select(F.col("conv_id").alias("file"), F.col("turn").alias("start"), (F.col("turn") + 1).alias("end"), F.concat(F.lit("u"), name, F.lit("_"), F.col("turn").cast("string")).alias("span"))
    points = c.select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), F.concat_ws(":", name, F.col("turn").cast("string")).alias("point"))
    return G.innermost(points, spans.unionByName(user))


@query("related_by_code", f"WITH {_REF}, p AS (SELECT investigation, symbol FROM r GROUP BY 1, 2) SELECT a.investigation AS a, b.investigation AS b, count(*) AS symbols FROM p a JOIN p b ON a.symbol = b.symbol AND a.investigation < b.investigation GROUP BY 1, 2")
def related_by_code(spark, sf):
    p = _references(spark, sf).select("investigation", "symbol").distinct()
    other = p.select(F.col("investigation").alias("b"), "symbol")
    return p.select(F.col("investigation").alias("a"), "symbol").join(other, "symbol").where("a < b").groupBy("a", "b").agg(F.count("*").alias("symbols"))


@query("reachable_levels", f"WITH RECURSIVE {FINDINGS_SQL}, e AS (SELECT derived_from AS src, id AS dst, (seq % 3)::INT AS level FROM findings WHERE derived_from IS NOT NULL), c(node, level) AS (SELECT id, 2 FROM findings WHERE seq % 5 = 0 UNION SELECT e.dst, least(c.level, e.level) FROM c JOIN e ON e.src = c.node) SELECT node, max(level)::INT AS level FROM c GROUP BY 1")
def reachable_levels(spark, sf):
    f = T.findings(spark, sf)
    edges = f.where("derived_from IS NOT NULL").select(F.col("derived_from").alias("src"), F.col("id").alias("dst"), (F.col("seq") % 3).cast("int").alias("level"))
    return G.widest_closure(f.where("seq % 5 = 0").select(F.col("id").alias("node"), F.lit(2).alias("level")), edges)


@query("dead_symbols", "SELECT p_partkey AS symbol FROM part WHERE p_partkey % 97 <> 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_partkey NOT IN (SELECT l_partkey + 1 FROM lineitem WHERE l_quantity < 3)")
def dead_symbols(spark, sf):
    li = read_table(spark, sf, "lineitem")
    calls = li.where("l_quantity > 45").select(F.col("l_partkey").alias("dst"))
    refs = li.where("l_quantity < 3").select((F.col("l_partkey") + 1).alias("symbol"))
    return G.dead(_symbols(spark, sf), calls, refs, F.col("symbol") % 97 == 0)


@query("subsystem_boundary", "SELECT direction, count(*) AS n FROM (SELECT CASE WHEN l_orderkey % 10 = 0 AND l_partkey % 10 <> 0 THEN 'out' WHEN l_orderkey % 10 <> 0 AND l_partkey % 10 = 0 THEN 'in' END AS direction FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) WHERE direction IS NOT NULL GROUP BY 1")
def subsystem_boundary(spark, sf):
    return G.boundary(T.refers_to(spark, sf), F.col("finding") % 10 == 0, F.col("symbol") % 10 == 0)


@query("investigation_footprint", f"WITH {_REF} SELECT investigation, count(DISTINCT finding) AS findings, count(DISTINCT symbol) AS symbols, min(symbol) AS first_symbol FROM r GROUP BY 1")
def investigation_footprint(spark, sf):
    return _references(spark, sf).groupBy("investigation").agg(F.count_distinct("finding").alias("findings"), F.count_distinct("symbol").alias("symbols"), F.min("symbol").alias("first_symbol"))


@query(
    "finding_symbol_links",
    """WITH t AS (SELECT 'f' || doc_id AS finding, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{3,}'))) AS token FROM documents), s AS (SELECT item_id || '::' || name AS symbol, name, item_id % 3 = 0 AS is_type FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS name FROM benchmark)),
    u AS (SELECT name, count(DISTINCT symbol) AS n FROM s GROUP BY 1), h AS (SELECT finding, symbol, CASE WHEN is_type THEN 2 WHEN n = 1 AND length(name) >= 8 THEN 1 END AS level FROM t JOIN s ON token = name JOIN u USING (name)) SELECT finding, symbol, max(level) AS level FROM h WHERE level IS NOT NULL GROUP BY 1, 2""",
)
def finding_symbol_links(spark, sf):
    words = F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]{3,}"), F.lit(0))
    tokens = T.findings(spark, sf).select(F.col("id").alias("finding"), F.explode(F.array_distinct(words)).alias("token"), F.lit(False).alias("exact"))
    names = F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0))
    symbols = T.claims(spark, sf).select(F.explode(names).alias("name"), "item_id").select(F.concat_ws("::", F.col("item_id").cast("string"), "name").alias("symbol"), "name", (F.col("item_id") % 3 == 0).alias("is_type"))
    return G.link_findings(tokens, symbols)


@query("call_resolution", "WITH s AS (SELECT p_partkey AS symbol, 'n' || (p_partkey % 300) AS name, 'o' || (p_partkey % 70) AS owner, 'f' || (p_partkey % 11) AS file FROM part), c AS (SELECT l_orderkey || '-' || l_linenumber AS call, 'n' || (l_partkey % 300) AS name, 'o' || (l_suppkey % 70) AS owner, 'f' || (l_linenumber % 11) AS file FROM lineitem), a AS (SELECT name, owner, min(symbol) AS s1 FROM s GROUP BY 1, 2 HAVING count(DISTINCT symbol) = 1), b AS (SELECT name, file, min(symbol) AS s2 FROM s GROUP BY 1, 2 HAVING count(DISTINCT symbol) = 1), u AS (SELECT name, min(symbol) AS s3 FROM s GROUP BY 1 HAVING count(DISTINCT symbol) = 1) SELECT call, coalesce(s1, s2, s3) AS symbol, CASE WHEN s1 IS NOT NULL THEN 'class' WHEN s2 IS NOT NULL THEN 'file' WHEN s3 IS NOT NULL THEN 'unique' ELSE 'unresolved' END AS rung FROM c LEFT JOIN a USING (name, owner) LEFT JOIN b USING (name, file) LEFT JOIN u USING (name)")
def call_resolution(spark, sf):
    n = lambda p, c, m: F.concat(F.lit(p), (F.col(c) % m).cast("string"))
    symbols = read_table(spark, sf, "part").select(F.col("p_partkey").alias("symbol"), n("n", "p_partkey", 300).alias("name"), n("o", "p_partkey", 70).alias("owner"), n("f", "p_partkey", 11).alias("file"))
    calls = read_table(spark, sf, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("call"), n("n", "l_partkey", 300).alias("name"), n("o", "l_suppkey", 70).alias("owner"), n("f", "l_linenumber", 11).alias("file"))
    return G.resolve_calls(calls, symbols)
