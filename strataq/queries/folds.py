"""Queries on folds, lifecycle and access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.operators import folds as O
from strataq.plans import tables as T
from strataq.plans.tables import EPOCH, FINDINGS_SQL, NOW, RESOLUTIONS_SQL, RETRACTIONS_SQL, STEP
from strataq.queries.base import query
from strataq.storage import read_table

_OVERRIDES = "overrides AS (SELECT finding_id, arg_max(resolution, seq) AS override FROM resolution_log WHERE resolution IN ('open', 'fixed', 'intentional', 'wontfix', 'superseded') GROUP BY 1)"
_GONE = "gone AS (SELECT finding_id FROM retraction_log GROUP BY 1 HAVING arg_max(active, seq))"


@query("latest_state_by_key", f"WITH {RESOLUTIONS_SQL}, {_OVERRIDES} SELECT * FROM overrides")
def latest_state_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return O.resolution_overrides(T.resolution_log(spark, sf))


@query("latest_event_by_user", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_event_by_user(spark, sf):
    return O.latest(read_table(spark, sf, "events"), "user_id", "event_id", "event_type")


@query("retracted_ids", f"WITH {RETRACTIONS_SQL}, {_GONE} SELECT finding_id FROM gone")
def retracted_ids(spark, sf):
    return O.retracted_ids(T.retraction_log(spark, sf))


@query("finding_lifecycle", f"WITH {FINDINGS_SQL}, {RESOLUTIONS_SQL}, {_OVERRIDES} SELECT id, coalesce(override, 'open') AS resolution FROM findings LEFT JOIN overrides ON id = finding_id")
def finding_lifecycle(spark, sf):
    return O.with_lifecycle(T.findings(spark, sf).select("id"), O.resolution_overrides(T.resolution_log(spark, sf)))


@query(
    "tombstone_filter",
    f"""WITH {FINDINGS_SQL}, {RETRACTIONS_SQL}, {_GONE},
    texts AS (SELECT DISTINCT investigation_id, trim(text, ' ') AS t FROM findings JOIN gone ON id = finding_id WHERE trim(text, ' ') <> '')
    SELECT id, investigation_id FROM findings f WHERE id NOT IN (SELECT finding_id FROM gone)
    AND NOT EXISTS (SELECT 1 FROM texts x WHERE x.investigation_id = f.investigation_id AND x.t = trim(f.text, ' '))""",
)
def tombstone_filter(spark, sf):
    return O.without_retracted(T.findings(spark, sf).select("id", "investigation_id", "text"), O.retracted_ids(T.retraction_log(spark, sf))).select("id", "investigation_id")


@query("finding_validation", f"WITH {FINDINGS_SQL} SELECT id, CASE WHEN record_type NOT IN ('observed', 'inferred', 'assumed', 'gap', 'procedure') THEN 'finding_type' WHEN confidence NOT IN ('high', 'medium', 'low') THEN 'confidence' WHEN tier NOT IN ('hot', 'warm', 'cold') THEN 'tier' WHEN lang NOT IN ('open', 'fixed', 'intentional', 'wontfix', 'superseded') OR lang IS NULL THEN 'resolution' END AS error, CASE confidence WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.3 END::DOUBLE AS numeric_confidence FROM findings")
def finding_validation(spark, sf):
    f = T.findings(spark, sf)
    return f.select("id", O.validation_error(F.col("record_type"), F.col("confidence"), F.col("tier"), F.col("lang")).alias("error"), O.numeric_confidence(F.col("confidence")).alias("numeric_confidence"))


@query("confidence_floor", f"WITH {FINDINGS_SQL} SELECT id, confidence FROM findings WHERE confidence IN ('medium', 'high')")
def confidence_floor(spark, sf):
    return T.findings(spark, sf).where(O.confidence_at_least(F.col("confidence"), "medium")).select("id", "confidence")


@query("as_of_snapshot", f"WITH {FINDINGS_SQL} SELECT id, created_at_ts, valid_until FROM findings WHERE created_at_ts <= {EPOCH + 300_000} AND coalesce(valid_until >= {EPOCH + 300_000}, TRUE)")
def as_of_snapshot(spark, sf):
    return O.as_of(T.findings(spark, sf), EPOCH + 300_000).select("id", "created_at_ts", "valid_until")


@query("investigation_load_recent", f"WITH {FINDINGS_SQL}, {RETRACTIONS_SQL}, {_GONE} SELECT investigation_id, id, summary FROM (SELECT investigation_id, id, substr(text, 1, 300) AS summary, row_number() OVER (PARTITION BY investigation_id ORDER BY seq DESC) AS n FROM findings WHERE authored_by IN ('agent1', 'agent3') AND id NOT IN (SELECT finding_id FROM gone)) WHERE n <= 20")
def investigation_load_recent(spark, sf):
    f = T.findings(spark, sf)
    gone = O.retracted_ids(T.retraction_log(spark, sf))
    kept = O.visible_to(f.join(gone, f["id"] == gone["finding_id"], "left_anti"), "agent1", ("agent3",))
    return O.last_n(kept, ["investigation_id"], "seq", 20).select("investigation_id", "id", F.substring("text", 1, 300).alias("summary"))


@query("page_of_investigations", f"WITH {FINDINGS_SQL} SELECT investigation_id, count(*) AS findings, max(created_at_ts) AS updated_at FROM findings GROUP BY 1 ORDER BY updated_at DESC, investigation_id LIMIT 10 OFFSET 5")
def page_of_investigations(spark, sf):
    inv = T.findings(spark, sf).groupBy("investigation_id").agg(F.count("*").alias("findings"), F.max("created_at_ts").alias("updated_at"))
    return O.page(inv, [F.desc("updated_at"), F.asc("investigation_id")], 10, 5)


@query("rewrite_field", f"WITH {FINDINGS_SQL} SELECT id, CASE WHEN 'f' || seq IN (SELECT 'f' || doc_id FROM labels WHERE quality = 0) THEN 'cold' ELSE tier END AS tier FROM findings")
def rewrite_field(spark, sf):
    ids = read_table(spark, sf, "labels").where("quality = 0").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("id"))
    return O.with_field(T.findings(spark, sf).select("id", "tier"), ids, "id", "tier", F.lit("cold"))


@query("acl_share_unshare", f"WITH {FINDINGS_SQL}, a AS (SELECT investigation_id, list_sort(list(DISTINCT authored_by)) AS acl FROM findings GROUP BY 1) SELECT investigation_id, array_to_string(list_sort(list_distinct(list_concat(acl, ['agent9']))), ',') AS shared, array_to_string(list_filter(acl, lambda x: x <> 'agent1'), ',') AS unshared FROM a")
def acl_share_unshare(spark, sf):
    acl = T.findings(spark, sf).groupBy("investigation_id").agg(F.array_sort(F.collect_set("authored_by")).alias("acl"))
    join = lambda c: F.array_join(F.array_sort(c), ",")
    return acl.select("investigation_id", join(O.shared_with(F.col("acl"), ["agent9"])).alias("shared"), join(O.unshared_from(F.col("acl"), ["agent1"])).alias("unshared"))


@query("unknown_parents", f"WITH {FINDINGS_SQL} SELECT id, derived_from FROM findings WHERE derived_from IS NOT NULL AND derived_from NOT IN (SELECT id FROM findings)")
def unknown_parents(spark, sf):
    return O.unknown_parents(T.findings(spark, sf))


@query("open_obligations", "SELECT obligation_id, seq FROM (SELECT user_id AS obligation_id, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'closed' ELSE 'open' END AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND status = 'open'")
def open_obligations(spark, sf):
    log = read_table(spark, sf, "events").select(F.col("user_id").alias("obligation_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "closed").otherwise("open").alias("status"))
    return O.open_obligations(log).select("obligation_id", "seq")


@query("procedure_attempts", "SELECT user_id AS procedure_id, count(*) AS attempts, sum((event_type <> 'error')::INT)::BIGINT AS successes, round(sum((event_type <> 'error')::INT) / count(*), 4) AS success_rate FROM events GROUP BY 1")
def procedure_attempts(spark, sf):
    return O.attempt_counters(read_table(spark, sf, "events").select(F.col("user_id").alias("procedure_id"), (F.col("event_type") != "error").alias("success")))


@query("recent_hints", f"WITH {FINDINGS_SQL} SELECT id, round(1.0::DOUBLE / (1 + greatest(({NOW} - created_at_ts)::DOUBLE / 86400, 0) * 24), 9) AS recency FROM findings WHERE created_at_ts > {EPOCH + 10 * STEP} ORDER BY created_at_ts DESC, seq DESC LIMIT 20")
def recent_hints(spark, sf):
    return O.hints(T.findings(spark, sf), 20, EPOCH + 10 * STEP, NOW).select("id", F.round("recency", 9).alias("recency"))


_DUMP_SQL = r"""coalesce((length(text) > 1500 AND len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}')) > 0 AND (regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9_])(?:user|assistant|system)[ \t]*[:"]') OR len(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}'), lambda x: lower(x)))) / len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}')) < 0.35)) OR (regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9_])(?:user|assistant|system)[ \t]*[:"]') AND length(text) > 800), FALSE)"""


@query("noise_filter", rf"""WITH k AS (SELECT 'f' || doc_id AS id, row_number() OVER (PARTITION BY substr(lower(trim(regexp_replace(text, '[ \t\n\r\f\x0b]+', ' ', 'g'), ' ')), 1, 200) ORDER BY doc_id) AS n FROM documents WHERE trim(text, ' ') <> '' AND NOT regexp_matches(lower(source), 'pre_compress|session_end|session_dump|conversation|transcript|turn') AND NOT {_DUMP_SQL}) SELECT id FROM k WHERE n = 1""")
def noise_filter(spark, sf):
    return O.without_noise(T.findings(spark, sf), "seq", "investigation_id").select("id")


@query("triple_query", f"WITH {FINDINGS_SQL} SELECT investigation_id AS subject, record_type AS predicate, id AS object, created_at_ts FROM findings WHERE record_type = 'observed' ORDER BY created_at_ts DESC, id LIMIT 50")
def triple_query(spark, sf):
    triples = T.findings(spark, sf).select(F.col("investigation_id").alias("subject"), F.col("record_type").alias("predicate"), F.col("id").alias("object"), "created_at_ts")
    return triples.where("predicate = 'observed'").orderBy(F.desc("created_at_ts"), "object").limit(50)


@query("conflict_list", f"WITH {FINDINGS_SQL} SELECT id AS finding_id_a, derived_from AS finding_id_b, CASE seq % 4 WHEN 0 THEN 'a_wins' WHEN 1 THEN 'b_wins' WHEN 2 THEN 'both_valid' ELSE 'open' END AS status FROM findings WHERE derived_from IS NOT NULL AND seq % 4 = 3")
def conflict_list(spark, sf):
    state = F.element_at(F.array(*map(F.lit, ("a_wins", "b_wins", "both_valid", "open"))), (F.col("seq") % 4 + 1).cast("int"))
    rows = T.findings(spark, sf).where("derived_from IS NOT NULL").select(F.col("id").alias("finding_id_a"), F.col("derived_from").alias("finding_id_b"), state.alias("status"))
    return rows.where("status = 'open'")


@query("retrieval_tiers", f"WITH {FINDINGS_SQL} SELECT id, CASE tier WHEN 'warm' THEN 'hot' WHEN 'cold' THEN 'warm' ELSE tier END AS promoted, CASE tier WHEN 'hot' THEN 'warm' WHEN 'warm' THEN 'cold' ELSE tier END AS demoted, tier <> 'cold' AS indexed FROM findings")
def retrieval_tiers(spark, sf):
    step = lambda names: F.coalesce(*[F.when(F.col("tier") == a, b) for a, b in names], F.col("tier"))
    return T.findings(spark, sf).select("id", step([("warm", "hot"), ("cold", "warm")]).alias("promoted"), step([("hot", "warm"), ("warm", "cold")]).alias("demoted"), (F.col("tier") != "cold").alias("indexed"))


@query("important_failures", f"WITH {FINDINGS_SQL} SELECT id, importance FROM findings WHERE importance >= 0.25 AND created_at_ts > {EPOCH} ORDER BY importance DESC, created_at_ts DESC LIMIT 20")
def important_failures(spark, sf):
    return T.findings(spark, sf).where((F.col("importance") >= 0.25) & (F.col("created_at_ts") > EPOCH)).orderBy(F.desc("importance"), F.desc("created_at_ts")).limit(20).select("id", "importance")


@query("stale_findings", f"WITH {FINDINGS_SQL}, r AS (SELECT id, 'p' || (seq % 50) AS path, sha256(record_type) AS hash FROM findings), c AS (SELECT 'p' || (page_id % 40) AS path, max(sha256(CASE WHEN page_id % 3 = 0 THEN 'observed' ELSE 'gap' END)) AS hash FROM pages GROUP BY 1) SELECT r.id, max((r.hash <> c.hash)::INT)::BOOLEAN AS stale FROM r LEFT JOIN c USING (path) GROUP BY 1")
def stale_findings(spark, sf):
    refs = T.findings(spark, sf).select("id", F.concat(F.lit("p"), (F.col("seq") % 50).cast("string")).alias("path"), F.sha2("record_type", 256).alias("hash"))
    now = read_table(spark, sf, "pages").groupBy(F.concat(F.lit("p"), (F.col("page_id") % 40).cast("string")).alias("path")).agg(F.max(F.sha2(F.when(F.col("page_id") % 3 == 0, "observed").otherwise("gap"), 256)).alias("hash"))
    return O.staleness(refs, now)
