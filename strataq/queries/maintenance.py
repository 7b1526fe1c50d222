"""Queries on maintenance jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.operators import maintenance as M
from strataq.plans import tables as T
from strataq.plans.tables import FINDINGS_SQL, NOW
from strataq.queries.base import query
from strataq.storage import read_table


@query("refresh_candidates", f"WITH {FINDINGS_SQL}, d AS (SELECT id, seq, recall_count, least(greatest(11 - importance * 10, 1), 10) AS d, greatest(({NOW} - created_at_ts)::DOUBLE / 86400, 0) AS age FROM findings), r AS (SELECT id, seq, exp(-age / (greatest(1, d * 0.5) * pow(1 + recall_count::DOUBLE, 1 / greatest(1, d)))) AS r FROM d) SELECT id, round(r, 12) AS retention FROM r WHERE r < 0.3 ORDER BY r, seq LIMIT 50")
def refresh_candidates(spark, sf):
    return M.refresh_candidates(T.findings(spark, sf), NOW).select("id", F.round("retention", 12).alias("retention"))


@query("decay_applied", f"WITH {FINDINGS_SQL} SELECT id, round(greatest(0.05, importance * exp(-pow(greatest(({NOW} - created_at_ts)::DOUBLE / 86400, 0) / 30, 0.8))), 9) AS importance FROM findings")
def decay_applied(spark, sf):
    return M.decayed(T.findings(spark, sf), NOW).select("id", F.round("decayed", 9).alias("importance"))


@query("superseded_verdicts", "SELECT event_id AS id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id DESC) AS n FROM events) WHERE n > 1")
def superseded_verdicts(spark, sf):
    v = read_table(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("signature"), "value")
    return M.superseded(v, "signature", [F.desc("value"), F.desc("id")]).select("id")


@query("fact_cleanup", f"WITH {FINDINGS_SQL}, f AS (SELECT id, substr(text, 1, 3) AS subject, lower(record_type) AS object, importance AS confidence FROM findings) SELECT id FROM f WHERE NOT (trim(subject, ' ') IN ('The', 'A') OR object IN ('gap') OR (length(subject) < 4 AND confidence > 0 AND confidence < 0.5))")
def fact_cleanup(spark, sf):
    facts = T.findings(spark, sf).select("id", F.substring("text", 1, 3).alias("subject"), F.lower("record_type").alias("object"), F.col("importance").alias("confidence"))
    return M.clean_facts(facts, ("The", "A"), ("gap",)).select("id")


@query("stale_embeddings", "SELECT doc_id FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE embedding IS NULL OR coalesce(label, -1) % 3 <> 1")
def stale_embeddings(spark, sf):
    v = T.vectors(spark, sf).select("vec_id", F.col("vec").alias("vector"), F.lit("m").alias("model"), (F.col("label") % 3).cast("int").alias("version"))
    rows = read_table(spark, sf, "documents").select("doc_id").join(v, F.col("doc_id") == F.col("vec_id"), "left")
    return M.stale_embeddings(rows, "m", 1).select("doc_id")


@query("missing_embeddings", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings(spark, sf):
    v = T.vectors(spark, sf).select(F.col("vec_id").alias("doc_id"))
    return read_table(spark, sf, "documents").select("doc_id").join(v, "doc_id", "left_anti")


@query("store_probes", "SELECT 'dims' AS probe, count(*) FILTER (len(embedding) <> 64) AS bad, count(*) AS n FROM embeddings UNION ALL SELECT 'orphaned_labels', count(*) FILTER (d.doc_id IS NULL), count(*) FROM labels l LEFT JOIN documents d USING (doc_id)")
def store_probes(spark, sf):
    dims = T.vectors(spark, sf).agg(F.sum((F.size("vec") != 64).cast("long")).alias("bad"), F.count("*").alias("n")).select(F.lit("dims").alias("probe"), "bad", "n")
    docs = read_table(spark, sf, "documents").select("doc_id", F.lit(1).alias("_d"))
    lost = read_table(spark, sf, "labels").join(docs, "doc_id", "left").agg(F.sum(F.col("_d").isNull().cast("long")).alias("bad"), F.count("*").alias("n"))
    return dims.union(lost.select(F.lit("orphaned_labels"), "bad", "n"))


@query("dpo_pairs", "WITH n AS (SELECT user_id AS session_id, event_id, 'event ' || event_type || ' with value ' || event_id AS content, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) SELECT a.session_id, a.k, a.content AS rejected, b.content AS chosen FROM n a JOIN n b ON a.session_id = b.session_id AND a.k = b.k AND a.event_type = 'error' AND b.event_type = 'purchase' WHERE length(a.content) >= 20 AND length(b.content) >= 20 AND a.content <> b.content")
def dpo_pairs(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), "event_type", F.concat(F.lit("event "), "event_type", F.lit(" with value "), F.col("event_id").cast("string")).alias("content"))
    pairs = M.correction_pairs(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"))
    return M.dpo_pairs(pairs, e)
