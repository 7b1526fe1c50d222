"""Queries on composed tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.functions import text as X
from strataq.operators import folds as O
from strataq.operators import retrieval as R
from strataq.operators import services as V
from strataq.plans import tables as T
from strataq.plans.tables import FINDINGS_SQL, RESOLUTIONS_SQL, RETRACTIONS_SQL, VECTORS_SQL
from strataq.queries.base import query
from strataq.queries.folds import _GONE, _OVERRIDES
from strataq.queries.metrics import _SCORED_SQL
from strataq.queries.pairs import _NEAR_SQL, _sets, greedy_sql
from strataq.queries.retrieval import _KNN_SQL, _LEXICAL_SQL, _base, _queries, _vector_queries
from strataq.storage import read_table


@query(
    "investigation_search",
    f"""WITH {_LEXICAL_SQL}, {RESOLUTIONS_SQL}, {_OVERRIDES}, {RETRACTIONS_SQL}, {_GONE}, texts AS (SELECT DISTINCT investigation_id, trim(text, ' ') AS t FROM findings JOIN gone ON id = finding_id WHERE trim(text, ' ') <> ''),
    live AS (SELECT f.*, coalesce(override, 'open') AS resolution FROM findings f LEFT JOIN overrides o ON o.finding_id = f.id WHERE f.id NOT IN (SELECT finding_id FROM gone) AND NOT EXISTS (SELECT 1 FROM texts x WHERE x.investigation_id = f.investigation_id AND x.t = trim(f.text, ' ')) AND confidence IN ('medium', 'high')),
    k AS (SELECT r.query, r.id, r.score, row_number() OVER (PARTITION BY r.query, l.investigation_id, l.record_type, substr(l.text, 1, 220) ORDER BY r.score DESC, r.id) AS n FROM ranked r JOIN live l ON l.id = r.id WHERE l.resolution = 'open' AND r.place <= 200)
    SELECT query, id, round(score, 9) AS score, place FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM k WHERE n = 1) WHERE place <= 10""",
)
def investigation_search(spark, sf):
    f = T.findings(spark, sf)
    hits = R.top_k(R.lexical_scores(_queries(spark, sf), f.select("id", X.tokens(F.col("text")).alias("tokens"))), 200).drop("place")
    out = V.search(hits, f, O.retracted_ids(T.retraction_log(spark, sf)), O.resolution_overrides(T.resolution_log(spark, sf)), "medium", "open")
    return out.select("query", "id", F.round("score", 9).alias("score"), "place")


@query("memory_route", None)
def memory_route(spark, sf):
    f = T.findings(spark, sf)
    hits = R.top_k(R.lexical_scores(_queries(spark, sf), f.select("id", X.tokens(F.col("text")).alias("tokens"))), 60).drop("place")
    acl = f.groupBy("investigation_id").agg(F.array(F.lit("agent1"), F.lit("agent2")).alias("acl"))
    return V.route(hits, f.select("id", "text", "authored_by", "investigation_id"), "agent0", acl, 10).select("query", "id", F.round("score", 9).alias("score"), "place")



@query("conflict_detection", f"WITH {_KNN_SQL}, {FINDINGS_SQL}, n AS (SELECT * FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM s) WHERE place <= 10), f AS (SELECT seq, record_type AS t, regexp_matches(lower(text), 'not |no |never|false') AS neg FROM findings) SELECT n.query, n.id, round(score, 4) AS score FROM n JOIN f a ON a.seq = n.query JOIN f b ON b.seq = n.id WHERE (b.t = 'gap' AND a.t = 'observed') OR (b.t = 'assumed' AND a.t <> 'assumed') OR a.neg <> b.neg")
def conflict_detection(spark, sf):
    near = R.knn(_vector_queries(spark, sf), _base(spark, sf), 10, places=6).select("query", "id", "score")
    return V.conflicts(near, T.findings(spark, sf).select(F.col("seq").alias("id"), "record_type", "text"))



@query("entity_lookup", "SELECT 'f' || doc_id AS id FROM documents WHERE regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9])password(?:[^A-Za-z0-9]|$)') OR doc_id % 100 = 7")
def entity_lookup(spark, sf):
    f = T.findings(spark, sf)
    stored = f.where("seq % 100 = 7").select("id", F.lit("Password").alias("entity"))
    return V.entity_lookup(f, stored, "password")


@query("retraction_dry_run", None)
def retraction_dry_run(spark, sf):
    seeds = read_table(spark, sf, "labels").where("toxic = 1").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("node"))
    f = T.findings(spark, sf)
    mentions = f.select(F.col("id").alias("node"), F.explode(X.distinctive(X.entities(F.col("text")))).alias("entity"))
    cluster, stones = V.retract(f, seeds, mentions, T.NOW, dry_run=False)
    return cluster.groupBy("reason").agg(F.count("*").alias("n")).unionByName(V.restore(stones).groupBy("reason").agg(F.count("*").alias("n")))


@query("investigation_summaries", f"WITH {FINDINGS_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY seq DESC) AS n FROM findings), c AS (SELECT investigation_id, count(*) AS c FROM findings GROUP BY 1) SELECT investigation_id, string_agg(substr(text, 1, 100), ' | ' ORDER BY seq) AS brief, 'Investigation with ' || max(c) || ' findings. Latest: ' || arg_max(substr(text, 1, 100), seq) AS line FROM l JOIN c USING (investigation_id) WHERE n <= 5 GROUP BY 1")
def investigation_summaries(spark, sf):
    return V.summaries(T.findings(spark, sf))


@query("judged_contradictions", f"WITH {VECTORS_SQL}, f AS (SELECT doc_id, regexp_matches(lower(text), '(?:^|[^a-z0-9_])(?:no|not|never|none|without|cannot|can''t|didn''t|isn''t|aren''t|won''t)(?:[^a-z0-9_]|$)') AS n FROM documents) SELECT a, b, similarity FROM (SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.vec, y.vec), 6) AS similarity FROM vectors x JOIN vectors y ON x.vec_id < y.vec_id) JOIN f p ON p.doc_id = a JOIN f q ON q.doc_id = b WHERE p.n <> q.n AND similarity >= 0.35 ORDER BY similarity DESC, a, b LIMIT 40")
def judged_contradictions(spark, sf):
    from strataq.operators import pairs as P

    near = P.similar_vectors(T.vectors(spark, sf), 0.34, pivots=16).withColumn("similarity", F.round("similarity", 6))
    return V.judged_contradictions(near, read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), 0.35)


@query("coalesced_verdicts", greedy_sql(_NEAR_SQL.format(more="", t=0.4) + " AND a.label = b.label") + " SELECT label AS kind, rep, count(*) AS occurrences FROM greedy GROUP BY 1, 2")
def coalesced_verdicts(spark, sf):
    return V.coalesced_verdicts(T.vectors(spark, sf).withColumnRenamed("label", "kind"), 0.4)


@query(
    "leave_one_run_out",
    f"""WITH {_SCORED_SQL.replace("SELECT quality", "SELECT doc_id % 5 AS run, quality")}, t AS (SELECT 0.3::DOUBLE + i * ((1.0::DOUBLE - 0.3::DOUBLE) / 70) AS threshold FROM range(71) r(i)), p AS (SELECT run, threshold, sum((score >= threshold AND label = 1)::INT) AS tp, sum((score >= threshold)::INT) AS kept, sum((label = 1)::INT) AS pos FROM scored, t GROUP BY 1, 2),
    f AS (SELECT run, threshold, 2.0::DOUBLE * tp / (kept + pos) AS f1, 2.0::DOUBLE * (sum(tp) OVER w - tp) / (sum(kept) OVER w - kept + sum(pos) OVER w - pos) AS train FROM p WINDOW w AS (PARTITION BY threshold))
    SELECT run, round(arg_max(threshold, (train, -threshold)), 6) AS threshold, round(arg_max(f1, (train, -threshold)), 6) AS f1 FROM f GROUP BY 1""",
)
def leave_one_run_out(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", F.round((F.col("n_chars") % 997) / F.lit(997.0), 3).alias("score"))
    rows = read_table(spark, sf, "labels").join(docs, "doc_id").select((F.col("doc_id") % 5).alias("run"), F.col("quality").alias("label"), "score")
    return V.leave_one_out(rows, "run", "label", "score").select("run", F.round("threshold", 6).alias("threshold"), F.round("f1", 6).alias("f1"))



@query("node_degrees", "WITH e AS (SELECT DISTINCT l_orderkey AS src, -l_partkey - 1 AS dst FROM lineitem), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node, (SELECT count(*) FROM e WHERE src = node) AS out_degree, (SELECT count(*) FROM e WHERE dst = node) AS in_degree FROM n")
def node_degrees(spark, sf):
    e = T.refers_to(spark, sf).select(F.col("finding").alias("src"), (-F.col("symbol") - 1).alias("dst"))
    return V.edge_lists(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), e)


@query("changed_sessions", "WITH n AS (SELECT conv_id AS session_id, count(*) AS messages FROM conversations GROUP BY 1) SELECT session_id, messages FROM n WHERE session_id % 3 <> 0 OR messages <> 5")
def changed_sessions(spark, sf):
    now = read_table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("messages"))
    cache = now.where("session_id % 3 = 0").select("session_id", F.lit(5).alias("messages"))
    return V.changed_sessions(now, cache)


@query("critic_training", None)
def critic_training(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", F.array(F.log1p("n_chars"), (F.col("doc_id") % 7).cast("double")).alias("features"))
    rows = read_table(spark, sf, "labels").join(docs, "doc_id").select("features", F.col("quality").alias("label"))
    model = V.train_critic(rows)
    return spark.createDataFrame([(model is not None, 0 if model is None else int(model.numFeatures))], "trained boolean, features int")
