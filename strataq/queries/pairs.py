"""Queries on pair joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.functions import text as X
from strataq.operators import maintenance as M
from strataq.operators import pairs as P
from strataq.operators.sweeps import greedy_vectors, losing_vectors
from strataq.plans import tables as T
from strataq.plans.tables import FINDINGS_SQL, VECTORS_SQL
from strataq.queries.base import query
from strataq.queries.texts import NEGATED_SQL, TOKENS_SQL
from strataq.storage import read_table


def _sets(spark, sf):
    return T.findings(spark, sf).select("id", X.tokens(F.col("text")).alias("tokens"))




@query("claim_evidence", f"WITH c AS (SELECT item_id, {TOKENS_SQL('text')} AS t, {NEGATED_SQL('text')} AS n FROM benchmark), d AS (SELECT 'f' || doc_id AS id, {TOKENS_SQL('text')} AS t, {NEGATED_SQL('text')} AS n FROM documents), s AS (SELECT item_id, id, len(list_intersect(c.t, d.t)) / len(c.t) AS score, c.n <> d.n AS opposed FROM c, d WHERE len(c.t) > 0) SELECT item_id, id, round(score, 9) AS score, CASE WHEN opposed AND score >= 0.5 THEN 'contradiction' ELSE 'support' END AS relation FROM s WHERE score >= 0.45")
def claim_evidence(spark, sf):
    """Claims, the stated query set, against all findings."""
    claims = T.claims(spark, sf).select(F.col("item_id").alias("id"), X.tokens(F.col("text")).alias("tokens"), X.is_negated(F.col("text")).alias("n"))
    f = T.findings(spark, sf).select("id", X.tokens(F.col("text")).alias("tokens"), X.is_negated(F.col("text")).alias("m"))
    pairs = P.containment_join(claims, f, 0.45).withColumn("score", F.col("common") / F.col("l_size"))
    pairs = pairs.join(claims.select(F.col("id").alias("l"), "n"), "l").join(f.select(F.col("id").alias("r"), "m"), "r")
    relation = F.when((F.col("n") != F.col("m")) & (F.col("score") >= 0.5), "contradiction").otherwise("support")
    return pairs.select(F.col("l").alias("item_id"), F.col("r").alias("id"), F.round("score", 9).alias("score"), relation.alias("relation"))


_WORDS_SQL = "list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n]+'), lambda w: w <> ''))"



@query("similar_vectors", f"WITH {VECTORS_SQL} SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.vec, b.vec), 6) AS similarity FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.vec, b.vec) >= 0.4")
def similar_vectors(spark, sf):
    return P.similar_vectors(T.vectors(spark, sf), 0.4).select("a", "b", F.round("similarity", 6).alias("similarity"))


def greedy_sql(pairs: str) -> str:
    """CTEs that end in ``greedy`` (vec_id, label, rep) of pairs (a, b), a < b: one vector after another, by a list of the representatives so far."""
    return f"""WITH RECURSIVE {VECTORS_SQL}, pairs AS ({pairs}), v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS n, coalesce(near, []) AS near FROM vectors LEFT JOIN (SELECT b AS vec_id, list(a) AS near FROM pairs GROUP BY 1) USING (vec_id)),
    walk(i, reps) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT i + 1, CASE WHEN list_has_any(reps, near) THEN reps ELSE list_append(reps, vec_id) END FROM walk JOIN v ON n = i + 1),
    greedy AS (SELECT vec_id, label, CASE WHEN list_contains(reps, vec_id) THEN vec_id ELSE list_min(list_intersect(reps, near)) END AS rep FROM v, (SELECT arg_max(reps, i) AS reps FROM walk))"""


_NEAR_SQL = "SELECT a.vec_id AS a, b.vec_id AS b{more} FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.vec, b.vec) >= {t}"


@query("greedy_dedup", greedy_sql(_NEAR_SQL.format(more="", t=0.3)) + " SELECT vec_id, rep FROM greedy")
def greedy_dedup(spark, sf):
    return greedy_vectors(T.vectors(spark, sf), 0.3)


@query(
    "winner_takes_all",
    f"""WITH RECURSIVE {VECTORS_SQL}, pairs AS ({_NEAR_SQL.format(more=", a.vec_id % 20 >= b.vec_id % 20 AS first", t=0.3)}), v AS (SELECT a, row_number() OVER (ORDER BY a) AS n, list(b) FILTER (first) AS weaker, list(b) FILTER (NOT first) AS stronger FROM pairs GROUP BY 1),
    walk(i, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
      SELECT i + 1, CASE WHEN list_contains(gone, a) THEN gone ELSE list_distinct(gone || coalesce(weaker, []) || CASE WHEN len(list_filter(coalesce(stronger, []), lambda b: NOT list_contains(gone, b))) > 0 THEN [a] ELSE [] END) END FROM walk JOIN v ON n = i + 1)
    SELECT unnest(arg_max(gone, i)) AS vec_id FROM walk""",
)
def winner_takes_all(spark, sf):
    v = T.vectors(spark, sf)
    return losing_vectors(v.select("vec_id", "vec", (F.col("vec_id") % 20).cast("double").alias("importance")), 0.3)


@query("skill_shadow_pairs", f"WITH {VECTORS_SQL} SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.vec, b.vec) >= 0.3 AND a.label = b.label")
def skill_shadow_pairs(spark, sf):
    return P.similar_vectors(T.vectors(spark, sf), 0.3, same="label").select("a", "b")


@query(
    "cross_links",
    f"""WITH {VECTORS_SQL}, s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.vec, b.vec) AS sim, lower(x.text) AS ta, lower(y.text) AS tb FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id JOIN documents x ON x.doc_id = a.vec_id JOIN documents y ON y.doc_id = b.vec_id WHERE list_cosine_similarity(a.vec, b.vec) >= 0.35),
    c AS (SELECT *, string_split_regex(ta || ' ' || tb, '[ \\t\\n]+') AS w, regexp_matches(tb, 'because|caused by|due to|as a result|triggered by|led to|resulting from|following|after') AS cb, regexp_matches(ta, 'because|caused by|due to|as a result|triggered by|led to|resulting from|following|after') AS ca FROM s)
    SELECT a AS source, b AS target, 'semantic_link' AS edge_type FROM c
    UNION ALL SELECT a, b, 'contradicts' FROM c WHERE sim > 0.96 AND ((list_contains(w, 'true') AND list_contains(w, 'false')) OR (list_contains(w, 'enabled') AND list_contains(w, 'disabled')) OR (list_contains(w, 'success') AND list_contains(w, 'failure')))
    UNION ALL SELECT a, b, 'updated_by' FROM c WHERE sim >= 0.92 AND regexp_matches(tb, 'updated|revised|corrected|supersedes|replaces|now|actually|new finding|correction:|update:|revision:')
    UNION ALL SELECT CASE WHEN cb THEN b ELSE a END, CASE WHEN cb THEN a ELSE b END, 'caused_by' FROM c WHERE cb OR ca""",
)
def cross_links(spark, sf):
    texts = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return P.cross_links(P.similar_vectors(T.vectors(spark, sf), 0.35), texts)


@query("causal_edges", f"WITH {FINDINGS_SQL}, l AS (SELECT *, lower(trim(substr(text, 1, 60), ' ')) AS s FROM (SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY seq DESC) AS n FROM findings) WHERE n <= 10) SELECT a.id AS source_id, b.id AS target_id FROM l a JOIN l b ON a.investigation_id = b.investigation_id AND a.seq < b.seq WHERE contains(b.text, a.id) OR (length(a.s) > 10 AND contains(lower(b.text), a.s) AND regexp_matches(lower(b.text), '(?:^|[^a-z0-9_])(?:because|caused|led to|resulted in|after|following|due to|triggered)(?:[^a-z0-9_]|$)'))")
def causal_edges(spark, sf):
    return P.causal_edges(T.findings(spark, sf))


_MENTIONS_SQL = "SELECT source AS \"case\", unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_.%+-]+@[A-Za-z0-9_.-]+[.][A-Za-z]{2,}'), lambda x: lower(x)))) AS entity FROM documents UNION ALL SELECT source, unnest(list_distinct(regexp_extract_all(text, '\\b[0-9]{1,3}(?:[.][0-9]{1,3}){3}\\b'))) FROM documents"


def _mentions(spark, sf):
    e = X.entities(F.col("text"))
    return read_table(spark, sf, "documents").select(F.col("source").alias("case"), F.explode(F.concat(e["emails"], e["ips"])).alias("entity"))


@query("entity_cross_case", f"WITH m AS ({_MENTIONS_SQL}) SELECT entity, count(DISTINCT \"case\") AS cases, count(*) AS refs FROM m GROUP BY 1 HAVING count(DISTINCT \"case\") > 1")
def entity_cross_case(spark, sf):
    return P.shared_entities(_mentions(spark, sf))


@query("related_cases", f"WITH m AS (SELECT DISTINCT * FROM ({_MENTIONS_SQL})) SELECT a.\"case\" AS case_a, b.\"case\" AS case_b, count(*) AS shared FROM m a JOIN m b ON a.entity = b.entity AND a.\"case\" < b.\"case\" GROUP BY 1, 2")
def related_cases(spark, sf):
    return P.related_cases(_mentions(spark, sf))


@query("rename_drift", "WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS token FROM benchmark), f AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS field FROM conversations) SELECT token, field FROM t JOIN f ON token <> field AND ((length(token) > length(field) AND (starts_with(token, field) OR ends_with(token, field))) OR (length(field) > length(token) AND (starts_with(field, token) OR ends_with(field, token))))")
def rename_drift(spark, sf):
    words = lambda t, name: read_table(spark, sf, t).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias(name))
    return P.rename_drift(words("benchmark", "token"), words("conversations", "field"))


@query("hard_negatives", f"WITH c AS (SELECT item_id AS id, item_id % 4 AS label, {TOKENS_SQL('text')} AS t FROM benchmark) SELECT a.id AS a, b.id AS b, len(list_intersect(a.t, b.t)) AS common FROM c a JOIN c b ON a.id < b.id AND a.label <> b.label WHERE len(list_intersect(a.t, b.t)) >= 3 ORDER BY common DESC, 1, 2 LIMIT 100")
def hard_negatives(spark, sf):
    sets = T.claims(spark, sf).select(F.col("item_id").alias("id"), (F.col("item_id") % 4).alias("label"), X.tokens(F.col("text")).alias("tokens"))
    return P.hard_negatives(sets, 3, 100)


@query("correction_pairs", "WITH n AS (SELECT user_id AS session_id, event_id AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'error'), p AS (SELECT user_id AS session_id, event_id AS corrected, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'purchase') SELECT session_id, k, failed, corrected FROM n JOIN p USING (session_id, k)")
def correction_pairs(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), "event_type")
    return M.correction_pairs(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"))


@query("merged_entities", None)
def merged_entities(spark, sf):
    m = T.findings(spark, sf).select("investigation_id", "seq", F.explode(X.named_entities(F.col("text"))).alias("name"))
    return P.merged_entities(m.select("investigation_id", "name", F.col("seq").alias("place")))


@query("route_acl", f"WITH {FINDINGS_SQL} SELECT id FROM findings WHERE authored_by = 'agent2' OR (investigation_id IN ('src1', 'src2', 'src3') AND authored_by IN ('agent0', 'agent4'))")
def route_acl(spark, sf):
    f = T.findings(spark, sf)
    lists = f.where(F.col("investigation_id").isin("src1", "src2", "src3")).select(F.col("investigation_id").alias("_inv"), F.array(F.lit("agent0"), F.lit("agent4")).alias("acl")).distinct()
    open_ = (F.col("authored_by") == "agent2") | F.coalesce(F.array_contains("acl", F.col("authored_by")), F.lit(False))
    return f.join(lists, F.col("investigation_id") == F.col("_inv"), "left").where(open_).select("id")


@query(
    "failure_correlation",
    f"""WITH w AS (SELECT doc_id, source, (doc_id % 20 + 1)::DOUBLE / 20::DOUBLE AS importance, {_WORDS_SQL} AS w FROM documents), f AS (SELECT 'src' || (item_id % 5) AS s, {_WORDS_SQL} AS w FROM benchmark)
    SELECT 'f' || doc_id AS id, round(CASE WHEN (doc_id % 3 = 0 AND source IN (SELECT s FROM f)) OR EXISTS (SELECT 1 FROM f WHERE len(list_intersect(w.w, f.w)) >= 6) THEN greatest(0.05::DOUBLE, importance * 0.85::DOUBLE) ELSE importance END, 9) AS importance FROM w""",
)
def failure_correlation(spark, sf):
    f = T.findings(spark, sf)
    memories = f.select("id", F.col("text").alias("content"), "importance", F.when(F.col("seq") % 3 == 0, F.col("investigation_id")).alias("session_id"))
    fails = T.claims(spark, sf).select(F.col("item_id").alias("fail_id"), F.col("text").alias("content"), F.concat(F.lit("src"), (F.col("item_id") % 5).cast("string")).alias("session_id"))
    return M.penalised(memories, fails).select("id", F.round("importance", 9).alias("importance"))
