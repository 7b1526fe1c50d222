"""Queries on aggregation, windows, set operations and incremental reads."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataq.functions import text as X
from strataq.operators import folds as O
from strataq.operators import maintenance as M
from strataq.operators import windows as W
from strataq.plans import tables as T
from strataq.plans.tables import FINDINGS_SQL
from strataq.queries.base import query
from strataq.storage import read_table


@query("recent_per_type", f"WITH {FINDINGS_SQL} SELECT record_type, id, total FROM (SELECT record_type, id, row_number() OVER (PARTITION BY record_type ORDER BY seq DESC) AS n, count(*) OVER (PARTITION BY record_type) AS total FROM findings) WHERE n <= 3")
def recent_per_type(spark, sf):
    f = T.findings(spark, sf).select("record_type", "id", "seq")
    totals = f.groupBy("record_type").agg(F.count("*").alias("total"))
    return O.last_n(f, ["record_type"], "seq", 3).join(totals, "record_type").select("record_type", "id", "total")


@query("tier_counts_rollup", f"WITH {FINDINGS_SQL} SELECT investigation_id, count(*) AS total, sum((tier = 'hot')::INT)::BIGINT AS hot, sum((tier = 'cold')::INT)::BIGINT AS cold, sum((tier NOT IN ('hot', 'cold'))::INT)::BIGINT AS warm FROM findings GROUP BY ROLLUP (investigation_id)")
def tier_counts_rollup(spark, sf):
    n = lambda c: F.sum(c.cast("long"))
    t = F.col("tier")
    return T.findings(spark, sf).rollup("investigation_id").agg(F.count("*").alias("total"), n(t == "hot").alias("hot"), n(t == "cold").alias("cold"), n(~t.isin("hot", "cold")).alias("warm"))


@query("self_check_rollup", f"WITH {FINDINGS_SQL} SELECT investigation_id, record_type, count(*) AS n FROM findings WHERE confidence = 'low' GROUP BY ROLLUP (investigation_id, record_type)")
def self_check_rollup(spark, sf):
    return T.findings(spark, sf).where("confidence = 'low'").rollup("investigation_id", "record_type").agg(F.count("*").alias("n"))


@query("health_rollup", f"WITH {FINDINGS_SQL}, p AS (SELECT investigation_id, max(CASE WHEN text IS NULL OR text = '' THEN 2 WHEN length(text) < 200 THEN 1 ELSE 0 END) AS severity, sum((length(text) < 200)::INT)::BIGINT AS short FROM findings GROUP BY 1) SELECT investigation_id, CASE severity WHEN 2 THEN 'error' WHEN 1 THEN 'warn' ELSE 'ok' END AS status, short FROM p")
def health_rollup(spark, sf):
    severity = F.when(F.coalesce("text", F.lit("")) == "", 2).when(F.length("text") < 200, 1).otherwise(0)
    p = T.findings(spark, sf).groupBy("investigation_id").agg(F.max(severity).alias("s"), F.sum((F.length("text") < 200).cast("long")).alias("short"))
    return p.select("investigation_id", F.when(F.col("s") == 2, "error").when(F.col("s") == 1, "warn").otherwise("ok").alias("status"), "short")


@query("entity_frequency_top", "SELECT source, email, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, email) AS place FROM (SELECT source, email, count(*) AS n FROM (SELECT source, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_.%+-]+@[A-Za-z0-9_.-]+[.][A-Za-z]{2,}'), lambda x: lower(x)))) AS email FROM documents) GROUP BY 1, 2)) WHERE place <= 5")
def entity_frequency_top(spark, sf):
    e = read_table(spark, sf, "documents").select("source", F.explode(X.entities(F.col("text"))["emails"]).alias("email")).groupBy("source", "email").agg(F.count("*").alias("n"))
    return W.top_per_key(e, ["source"], [F.desc("n"), F.asc("email")], 5)


@query("entity_timeline", "SELECT email, count(*) AS refs, min(doc_id) AS first_seen, max(doc_id) AS last_seen FROM (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_.%+-]+@[A-Za-z0-9_.-]+[.][A-Za-z]{2,}'), lambda x: lower(x)))) AS email FROM documents) GROUP BY 1")
def entity_timeline(spark, sf):
    e = read_table(spark, sf, "documents").select("doc_id", F.explode(X.entities(F.col("text"))["emails"]).alias("email"))
    return e.groupBy("email").agg(F.count("*").alias("refs"), F.min("doc_id").alias("first_seen"), F.max("doc_id").alias("last_seen"))


@query("events_by_op", "SELECT event_type AS op, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1")
def events_by_op(spark, sf):
    return read_table(spark, sf, "events").groupBy(F.col("event_type").alias("op")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("event_replay_tail", "SELECT event_id, event_type FROM (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20' AND event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 100)")
def event_replay_tail(spark, sf):
    return W.replay_tail(read_table(spark, sf, "events"), "ts", "event_id", "2024-01-03", "2024-01-20", 100, F.col("event_type") == "click").select("event_id", "event_type")


@query("reflection_counters", "SELECT kind, name, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) AS place FROM (SELECT 'event' AS kind, event_type AS name, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'user', user_id::VARCHAR, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'error', user_id::VARCHAR, count(*) FROM events WHERE event_type = 'error' GROUP BY 2)) WHERE place <= 8")
def reflection_counters(spark, sf):
    e = read_table(spark, sf, "events")
    u = F.col("user_id").cast("string")
    # One scan: each event counts under up to three kinds.
    named = F.array(F.struct(F.lit("event").alias("kind"), F.col("event_type").alias("name")), F.struct(F.lit("user").alias("kind"), u.alias("name")), F.when(F.col("event_type") == "error", F.struct(F.lit("error").alias("kind"), u.alias("name"))))
    counts = e.select(F.inline(F.filter(named, lambda x: x.isNotNull()))).groupBy("kind", "name").agg(F.count("*").alias("n"))
    return W.top_per_key(counts, ["kind"], [F.desc("n"), F.asc("name")], 8)


@query("verdict_coalescing", "SELECT user_id AS signature, count(*) AS occurrences, min(event_id) AS first_seen, max(event_id) AS last_seen, arg_max(event_type, (value, event_id)) AS verdict FROM events GROUP BY 1")
def verdict_coalescing(spark, sf):
    return read_table(spark, sf, "events").groupBy(F.col("user_id").alias("signature")).agg(F.count("*").alias("occurrences"), F.min("event_id").alias("first_seen"), F.max("event_id").alias("last_seen"), F.max_by("event_type", F.struct("value", "event_id")).alias("verdict"))


@query("verdict_winner", "SELECT signature, event_id, winner FROM (SELECT user_id AS signature, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) = 1 AS winner FROM events) WHERE winner")
def verdict_winner(spark, sf):
    best = read_table(spark, sf, "events").groupBy(F.col("user_id").alias("signature")).agg(F.max(F.struct("value", "event_id")).alias("b"))
    return best.select("signature", F.col("b.event_id").alias("event_id"), F.lit(True).alias("winner"))


@query("verdict_stats", "SELECT count(*) AS total, sum((n >= 2 AND errors > 0)::INT)::BIGINT AS recurring FROM (SELECT user_id, event_type, count(*) AS n, sum((event_type = 'error')::INT) AS errors FROM events GROUP BY 1, 2)")
def verdict_stats(spark, sf):
    s = read_table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("total"), F.sum(((F.col("n") >= 2) & (F.col("event_type") == "error")).cast("long")).alias("recurring"))


@query("near_duplicate_docs_exact", "SELECT sha256(coalesce(text, '')) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def near_duplicate_docs_exact(spark, sf):
    return read_table(spark, sf, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("search_dedupe", f"WITH {FINDINGS_SQL} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY investigation_id, record_type, substr(text, 1, 220) ORDER BY importance DESC, seq) AS n FROM findings) WHERE n = 1")
def search_dedupe(spark, sf):
    f = T.findings(spark, sf).withColumn("_k", F.sha2(F.substring("text", 1, 220), 256))
    return O.latest_rows(f, ["investigation_id", "record_type", "_k"], F.desc("importance"), F.asc("seq")).select("id")


@query("collection_union_best", "SELECT id, max(score) AS score FROM (SELECT user_id AS id, value AS score FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, value * 0.5::DOUBLE FROM events WHERE event_type <> 'click') GROUP BY 1")
def collection_union_best(spark, sf):
    e = read_table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("id")).agg(F.max(F.when(F.col("event_type") == "click", F.col("value")).otherwise(F.col("value") * 0.5)).alias("score"))


@query("session_text_oldest", "SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS body FROM (SELECT conv_id, turn, upper(role) || ': ' || text AS line, sum(length(upper(role) || ': ' || text)) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations WHERE length(text) > 20) WHERE run <= 4000 GROUP BY 1")
def session_text_oldest(spark, sf):
    return W.session_text(read_table(spark, sf, "conversations"), 4000, newest_first=False)


@query("session_text_latest", "SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS body FROM (SELECT conv_id, turn, upper(role) || ': ' || text AS line, sum(length(upper(role) || ': ' || text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS run FROM conversations WHERE length(text) > 20) WHERE run <= 4000 GROUP BY 1")
def session_text_latest(spark, sf):
    return W.session_text(read_table(spark, sf, "conversations"), 4000, newest_first=True)


@query("sync_delta", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def sync_delta(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id").join(read_table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("dangling_edges", "SELECT l_orderkey, l_partkey, sum((o_orderkey IS NULL)::INT)::BIGINT AS no_order FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P' GROUP BY 1, 2 HAVING sum((o_orderkey IS NULL)::INT) > 0")
def dangling_edges(spark, sf):
    orders = read_table(spark, sf, "orders").where("o_orderstatus <> 'P'").select("o_orderkey")
    lost = read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return lost.groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("no_order"))


@query("orphans", f"WITH {FINDINGS_SQL} SELECT id FROM findings f WHERE recall_count = 0 AND created_at_ts < 1759000000 AND NOT EXISTS (SELECT 1 FROM findings c WHERE c.derived_from = f.id)")
def orphans(spark, sf):
    f = T.findings(spark, sf)
    cited = f.select(F.col("derived_from").alias("_id")).where("_id IS NOT NULL").distinct()
    return f.where("recall_count = 0 AND created_at_ts < 1759000000").join(cited, F.col("id") == F.col("_id"), "left_anti").select("id")


@query("tiered_first_occurrence", "SELECT id, tier FROM (SELECT id, tier, row_number() OVER (PARTITION BY id ORDER BY rank) AS n FROM (SELECT doc_id AS id, 'working' AS tier, 1 AS rank FROM labels UNION ALL SELECT doc_id, 'episodic', 2 FROM documents)) WHERE n = 1")
def tiered_first_occurrence(spark, sf):
    return W.first_across_tiers({"working": read_table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "episodic": read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"))}, "id")


@query("skill_failures", "SELECT user_id, count(*) AS uses, sum((event_type = 'error')::INT)::BIGINT AS failures FROM events GROUP BY 1 HAVING count(*) >= 5 AND sum((event_type = 'error')::INT) >= 2")
def skill_failures(spark, sf):
    s = read_table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("uses"), F.sum((F.col("event_type") == "error").cast("long")).alias("failures"))
    return s.where("uses >= 5 AND failures >= 2")


@query("decay_summary", f"WITH {FINDINGS_SQL}, r AS (SELECT importance, exp(-pow(greatest((1760000000 - created_at_ts)::DOUBLE / 86400, 0) / 30, 0.8)) AS r FROM findings) SELECT count(*) AS n_rows, sum((abs(greatest(0.05, importance * r) - importance) > 1e-6)::INT)::BIGINT AS n_decayed, round(avg(r), 9) AS mean_retention, round(min(r), 9) AS min_retention FROM r")
def decay_summary(spark, sf):
    return M.decay_summary(T.findings(spark, sf), T.NOW)


@query("identifier_references", "WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9._:/-]{2,}')) AS name FROM documents) SELECT name, count(*) AS uses, count(*) > 1 AS referenced FROM t GROUP BY 1")
def identifier_references(spark, sf):
    t = read_table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(X.TOKEN), F.lit(0))).alias("name"))
    return t.groupBy("name").agg(F.count("*").alias("uses")).withColumn("referenced", F.col("uses") > 1)


@query("priority_queue", f"WITH {FINDINGS_SQL} SELECT id FROM findings ORDER BY CASE record_type WHEN 'gap' THEN 0 WHEN 'assumed' THEN 1 WHEN 'inferred' THEN 2 ELSE 3 END, seq LIMIT 25")
def priority_queue(spark, sf):
    rank = F.array_position(F.array(*map(F.lit, ("gap", "assumed", "inferred", "observed"))), F.col("record_type"))
    return T.findings(spark, sf).orderBy(rank, "seq").limit(25).select("id")


@query("memory_digest", f"WITH {FINDINGS_SQL} SELECT 'important' AS section, id FROM (SELECT id FROM findings WHERE importance >= 0.85 ORDER BY importance DESC, seq LIMIT 20) UNION ALL SELECT 'latest', id FROM (SELECT id FROM findings ORDER BY seq DESC LIMIT 20)")
def memory_digest(spark, sf):
    f = T.findings(spark, sf)
    top = f.where("importance >= 0.85").orderBy(F.desc("importance"), "seq").limit(20).select(F.lit("important").alias("section"), "id")
    return top.union(f.orderBy(F.desc("seq")).limit(20).select(F.lit("latest"), "id"))


@query("investigation_export", f"WITH {FINDINGS_SQL} SELECT investigation_id, count(*) AS findings, sum(octet_length(encode(text)))::BIGINT AS bytes, string_agg(id, ',' ORDER BY seq) AS ids FROM findings GROUP BY 1")
def investigation_export(spark, sf):
    """Each bundle lists its findings in order; a large one is an array of ids alone, never of texts."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]), ",")
    return T.findings(spark, sf).groupBy("investigation_id").agg(F.count("*").alias("findings"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), ids.alias("ids"))


@query("running_occurrences", "SELECT event_id, count(*) OVER w AS occurrences, count(*) OVER w >= 3 AS would_flag FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_occurrences(spark, sf):
    n = F.count("*").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return read_table(spark, sf, "events").where("event_type = 'error'").select("event_id", n.alias("occurrences"), (n >= 3).alias("would_flag"))


@query("claim_history", "SELECT event_id, lag(event_type) OVER w AS prior, count(*) OVER w - 1 AS prior_count FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def claim_history(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return read_table(spark, sf, "events").select("event_id", F.lag("event_type").over(w).alias("prior"), (F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("prior_count"))
