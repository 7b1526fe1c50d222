"""Queries on stores: verdicts, the mirrored graph, ledgers and maintenance jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.functions import text as X
from strataq.operators import folds as O
from strataq.operators import stores as W
from strataq.plans import tables as T
from strataq.plans.tables import FINDINGS_SQL, NOW, VECTORS_SQL
from strataq.queries.base import query
from strataq.queries.retrieval import _base, _vector_queries
from strataq.storage import read_table

_SIG_SQL = "sha256({k} || ':' || lower(trim(regexp_replace({t}, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'), ' ')))"
_VERDICTS_SQL = f"""v AS (SELECT seq, {_SIG_SQL.format(k='record_type', t='text')} AS signature, record_type AS kind, CASE WHEN seq % 3 = 0 THEN 'stale' ELSE 'unsupported' END AS verdict_type, CASE WHEN seq % 4 = 0 THEN 'block' ELSE 'allow' END AS decision, importance AS confidence, 'r' || seq AS rationale, (1 + seq % 3)::BIGINT AS occurrences, created_at_ts AS first_seen, created_at_ts AS last_seen, text AS excerpt FROM findings),
  one AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY signature, seq % 2 ORDER BY seq) = 1)"""


def _verdicts(spark, sf):
    """Findings as verdicts; even ones are in the store, odd ones new, each signature once."""
    f = T.findings(spark, sf)
    v = f.select(
        "seq", W.verdict_signature(F.col("record_type"), F.col("text")).alias("signature"), F.col("record_type").alias("kind"), F.when(F.col("seq") % 3 == 0, "stale").otherwise("unsupported").alias("verdict_type"),
        F.when(F.col("seq") % 4 == 0, "block").otherwise("allow").alias("decision"), F.col("importance").alias("confidence"), F.concat(F.lit("r"), F.col("seq").cast("string")).alias("rationale"),
        (F.col("seq") % 3 + 1).cast("long").alias("occurrences"), F.col("created_at_ts").alias("first_seen"), F.col("created_at_ts").alias("last_seen"), F.col("text").alias("excerpt"),
    )
    return tuple(O.latest_rows(v.where(F.col("seq") % 2 == k), ["signature"], F.asc("seq")).drop("seq") for k in (0, 1))


@query(
    "verdict_record",
    f"""WITH {FINDINGS_SQL}, {_VERDICTS_SQL}, a AS (SELECT * FROM one WHERE seq % 2 = 0), b AS (SELECT * FROM one WHERE seq % 2 = 1)
    SELECT coalesce(a.signature, b.signature) AS signature, coalesce(a.kind, b.kind) AS kind, CASE WHEN b.seq IS NULL OR a.confidence >= b.confidence THEN a.decision ELSE b.decision END AS decision, greatest(a.confidence, b.confidence) AS confidence,
      CASE WHEN a.seq IS NULL THEN b.occurrences WHEN b.seq IS NULL THEN a.occurrences ELSE greatest(a.occurrences, b.occurrences) + 1 END AS occurrences, coalesce(a.first_seen, b.first_seen) AS first_seen, coalesce(b.last_seen, a.last_seen) AS last_seen FROM a FULL JOIN b ON a.signature = b.signature""",
)
def verdict_record(spark, sf):
    store, new = _verdicts(spark, sf)
    return W.recorded(store, new).select("signature", "kind", "decision", "confidence", "occurrences", "first_seen", "last_seen")


@query("verdict_counts", f"WITH {FINDINGS_SQL}, {_VERDICTS_SQL}, a AS (SELECT * FROM one WHERE seq % 2 = 0) SELECT count(*) AS total_verdicts, count(*) FILTER (occurrences >= 2 AND decision = 'block') AS recurring_blocks FROM a WHERE signature NOT IN (SELECT {_SIG_SQL.format(k='record_type', t='text')} FROM findings WHERE seq % 10 = 0)")
def verdict_counts(spark, sf):
    """After those on every tenth finding were forgotten."""
    gone = T.findings(spark, sf).where("seq % 10 = 0").select(F.col("record_type").alias("kind"), F.col("text").alias("excerpt"))
    return W.verdict_counts(W.forgotten(_verdicts(spark, sf)[0], gone))


@query("verdict_recall", f"WITH {VECTORS_SQL}, s AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_cosine_similarity(a.vec, b.vec), 6) AS score FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND b.label % 3 = 1) SELECT query, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM s) WHERE place <= 5")
def verdict_recall(spark, sf):
    store = _base(spark, sf).select("id", "vec", F.concat(F.lit("kind"), (F.col("label") % 3).cast("string")).alias("kind"))
    return W.recalled(_vector_queries(spark, sf).select("query", "vec"), store, "kind1", 5, 6)


def _graph(spark, sf):
    f = T.findings(spark, sf).withColumn("derived_from", F.when(F.col("derived_from").isNotNull(), F.array("derived_from"))).withColumn("source", F.lit("docs"))
    mail = F.array_distinct(F.regexp_extract_all("text", F.lit(X.EMAIL), F.lit(0)))
    return W.mirrored(f, f.select("id", F.explode(mail).alias("entity"), F.lit("email").alias("etype")))


_MAIL_SQL = "m AS (SELECT DISTINCT id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_.%+-]+@[A-Za-z0-9_.-]+[.][A-Za-z]{2,}'))) AS entity FROM findings)"


@query(
    "graph_mirror",
    f"""WITH {FINDINGS_SQL}, {_MAIL_SQL} SELECT 'derived_from' AS part, count(*) AS n, count(DISTINCT derived_from) AS ends FROM findings WHERE derived_from IS NOT NULL UNION ALL SELECT 'entities', count(DISTINCT entity), count(DISTINCT entity) FROM m UNION ALL SELECT 'mentions', count(*), count(DISTINCT entity) FROM m
    UNION ALL SELECT 'findings', (SELECT count(*) FROM findings) + (SELECT count(DISTINCT derived_from) FROM findings WHERE derived_from NOT IN (SELECT id FROM findings)), (SELECT count(DISTINCT investigation_id) FROM findings) + (SELECT count(*) > 0 FROM findings WHERE derived_from NOT IN (SELECT id FROM findings))::INT
    UNION ALL SELECT 'investigations', count(DISTINCT investigation_id), count(DISTINCT investigation_id) FROM findings UNION ALL SELECT 'in_investigation', count(*), count(DISTINCT investigation_id) FROM findings""",
)
def graph_mirror(spark, sf):
    """Rows of each table of the mirrored graph, and the different ends or homes they have."""
    end = {"findings": "investigation_id", "investigations": "id", "entities": "entity"}
    parts = [df.agg(F.count("*").alias("n"), F.count_distinct(end.get(name, "dst")).alias("ends")).select(F.lit(name).alias("part"), "n", "ends") for name, df in _graph(spark, sf).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("graph_upsert", f"WITH {FINDINGS_SQL} SELECT investigation_id, count(*) AS n, sum(created_at_ts)::BIGINT AS stamps, count(*) FILTER (text = 'changed') AS changed FROM (SELECT investigation_id, CASE WHEN seq % 7 = 0 THEN created_at_ts + 5 ELSE created_at_ts END AS created_at_ts, CASE WHEN seq % 7 = 0 THEN 'changed' ELSE text END AS text FROM findings UNION ALL SELECT 'new', 1, 'changed') GROUP BY 1")
def graph_upsert(spark, sf):
    base = T.findings(spark, sf).select("id", "investigation_id", "text", "created_at_ts")
    new = base.where(F.expr("cast(substr(id, 2) AS bigint) % 7 = 0")).select("id", "investigation_id", F.lit("changed").alias("text"), (F.col("created_at_ts") + 5).alias("created_at_ts"))
    new = new.unionByName(spark.createDataFrame([("x1", "new", "changed", 1)], "id string, investigation_id string, text string, created_at_ts long"))
    return W.merged_rows(base, new, "id").groupBy("investigation_id").agg(F.count("*").alias("n"), F.sum("created_at_ts").alias("stamps"), F.count(F.when(F.col("text") == "changed", 1)).alias("changed"))


@query("graph_references", "SELECT DISTINCT l_orderkey AS finding, l_partkey AS symbol FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderkey % 3 = 0 AND p_partkey % 4 = 0")
def graph_references(spark, sf):
    """Only references between findings and symbols that are in the graph."""
    findings = read_table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"))
    return W.referenced(T.refers_to(spark, sf), findings, read_table(spark, sf, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("id")))


@query("node_merge", "WITH r AS (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS o, CASE WHEN l_linenumber % 2 = 0 THEN 'f' || l_suppkey END AS path, CASE WHEN l_linenumber > 2 THEN l_linenumber END AS line, 'k' || (l_linenumber % 3) AS k, 'v' || l_orderkey AS v FROM lineitem) SELECT id, arg_min(path, o) FILTER (path IS NOT NULL) AS path, arg_min(line, o) FILTER (line IS NOT NULL)::INT AS line, arg_max(v, o) FILTER (k = 'k1') AS k1, count(DISTINCT k) AS keys FROM r GROUP BY 1")
def node_merge(spark, sf):
    n = F.col("l_linenumber")
    rows = read_table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + n).alias("o"), F.when(n % 2 == 0, F.concat(F.lit("f"), F.col("l_suppkey").cast("string"))).alias("path"), F.when(n > 2, n.cast("int")).alias("line"),
        F.create_map(F.concat(F.lit("k"), (n % 3).cast("string")), F.concat(F.lit("v"), F.col("l_orderkey").cast("string"))).alias("attrs"),
    )
    return W.merged_nodes(rows, "o").select("id", "path", "line", F.col("attrs")["k1"].alias("k1"), F.size("attrs").cast("long").alias("keys"))


@query("flag_ranking", "WITH b AS (SELECT 'l' || p_partkey AS id, 'f' || (p_partkey % 9) AS path, (p_partkey % 50)::INT AS line, p_size % 5 AS rebinds, p_size % 7 AS exits, p_size % 3 AS form FROM part WHERE p_size % 2 = 0) SELECT id, path, line, 'flag' AS pattern, round(exits / greatest(1, rebinds), 9) AS score FROM b WHERE form = 0 OR (form = 1 AND rebinds > 0)")
def flag_ranking(spark, sf):
    size = F.col("p_size")
    forms = F.when(size % 3 == 0, F.array().cast("array<string>")).when(size % 3 == 1, F.array(F.lit("plain"))).otherwise(F.array(F.lit("plain"), F.lit("augmented")))
    b = read_table(spark, sf, "part").select(F.concat(F.lit("l"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("f"), (F.col("p_partkey") % 9).cast("string")).alias("path"), (F.col("p_partkey") % 50).cast("int").alias("line"), (size % 2 == 0).alias("init_is_constant"), forms.alias("assign_forms"), (size % 5).alias("constant_rebinds"), (size % 7).alias("guard_exits"))
    return W.ranked_flags(b).withColumn("score", F.round("score", 9))


@query(
    "canary_decision",
    """WITH s AS (SELECT doc_id % 40 AS run, doc_id AS finding, quality AS label, round(n_chars % 997 / 997::DOUBLE, 3) AS base, CASE WHEN quality = 1 THEN 0.9::DOUBLE ELSE round(n_chars % 499 / 499::DOUBLE, 3) END AS model FROM labels JOIN documents USING (doc_id)), big AS (SELECT run, count(DISTINCT finding) AS n FROM s GROUP BY 1 HAVING count(DISTINCT finding) >= 3),
    p AS (SELECT run, max(n) AS n, coalesce(2.0::DOUBLE * sum((base >= 0.59 AND label = 1)::INT) / nullif(sum((base >= 0.59)::INT) + sum((label = 1)::INT), 0), 0) AS b, coalesce(2.0::DOUBLE * sum((model >= 0.59 AND label = 1)::INT) / nullif(sum((model >= 0.59)::INT) + sum((label = 1)::INT), 0), 0) AS m FROM s JOIN big USING (run) GROUP BY 1)
    SELECT count(*) AS n_runs, coalesce(sum(n), 0)::BIGINT AS n_findings, round(avg(b), 6) AS base_f1, round(stddev_pop(b), 6) AS base_std, round(avg(m), 6) AS model_f1, round(stddev_pop(m), 6) AS model_std, CASE WHEN avg(m) - avg(b) >= 0.02 THEN 'PROMOTE' ELSE 'HOLD' END AS decision FROM p""",
)
def canary_decision(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", F.round((F.col("n_chars") % 997) / F.lit(997.0), 3).alias("base"), F.round((F.col("n_chars") % 499) / F.lit(499.0), 3).alias("other"))
    rows = read_table(spark, sf, "labels").join(docs, "doc_id").select((F.col("doc_id") % 40).alias("run"), F.col("doc_id").alias("finding"), F.col("quality").alias("label"), "base", F.when(F.col("quality") == 1, 0.9).otherwise(F.col("other")).alias("model"))
    r = lambda c: F.round(c, 6).alias(c)
    return W.canary(rows, 0.59, least=3).select("n_runs", "n_findings", r("base_f1"), r("base_std"), r("model_f1"), r("model_std"), "decision")


@query("causal_list", "SELECT 'e' || event_id AS source_id, 'u' || user_id AS target_id, event_type AS edge_type, coalesce(try_cast(CASE WHEN event_id % 4 = 0 THEN 'high' ELSE '0.' || (event_id % 10) END AS DOUBLE), 0) AS confidence, '' AS inferred_at FROM events WHERE user_id % 5 = 1")
def causal_list(spark, sf):
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = read_table(spark, sf, "events").select(s("src", "user_id").alias("_u"), (F.col("user_id") % 5).cast("string").alias("investigation_id"), s("e", "event_id").alias("source_id"), s("u", "user_id").alias("target_id"), F.col("event_type").alias("edge_type"), F.when(F.col("event_id") % 4 == 0, "high").otherwise(F.concat(F.lit("0."), (F.col("event_id") % 10).cast("string"))).alias("confidence"), F.lit(None).cast("string").alias("inferred_at"))
    return W.causal_list(edges, "1")


@query("latest_investigation_tail", f"WITH {FINDINGS_SQL}, n AS (SELECT investigation_id FROM findings GROUP BY 1 HAVING count(*) >= 3 ORDER BY max(created_at_ts) DESC, investigation_id LIMIT 1) SELECT id, created_at_ts FROM findings WHERE investigation_id IN (SELECT investigation_id FROM n) ORDER BY created_at_ts DESC, seq DESC LIMIT 10")
def latest_investigation_tail(spark, sf):
    return W.latest_tail(T.findings(spark, sf)).select("id", "created_at_ts")


@query(
    "suspect_correlation",
    f"""WITH RECURSIVE {FINDINGS_SQL}, {_MAIL_SQL}, s AS (SELECT DISTINCT lower(entity) AS token FROM m WHERE length(entity) % 5 = 0), seeds AS (SELECT id AS node FROM m JOIN s ON lower(entity) = token UNION SELECT id FROM findings JOIN s ON list_contains(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9._:/@-]{{2,}}'), token)),
    a AS (SELECT node FROM seeds UNION SELECT x.id FROM m x JOIN m y USING (entity) JOIN seeds z ON z.node = y.id), c AS (SELECT node FROM a UNION SELECT f.id FROM c JOIN findings f ON f.derived_from = c.node) SELECT node FROM c""",
)
def suspect_correlation(spark, sf):
    """What may go back to addresses that a code check flags, here those of certain lengths."""
    f = T.findings(spark, sf)
    mail = F.array_distinct(F.regexp_extract_all("text", F.lit(X.EMAIL), F.lit(0)))
    mentions = f.select(F.col("id").alias("node"), F.explode(mail).alias("entity"))
    parents = f.where("derived_from IS NOT NULL").select(F.col("id").alias("child"), F.col("derived_from").alias("parent"))
    words = f.select("id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9][a-z0-9._:/@-]{2,}"), F.lit(0))).alias("tokens"))
    return W.correlated(words, mentions, mentions.where(F.length("entity") % 5 == 0).select(F.col("entity").alias("token")), parents).select("node")


@query(
    "replay_batch",
    f"""WITH {FINDINGS_SQL}, c AS (SELECT *, {T.EPOCH} + 100 * {T.STEP} AS now FROM findings) SELECT id, priority FROM (SELECT id, seq, round(0.40::DOUBLE * exp(-ln(2::DOUBLE) / 3 * greatest((now - created_at_ts)::DOUBLE / 86400, 0) * 24)
      + 0.35::DOUBLE * least(1, importance * CASE confidence WHEN 'high' THEN 1.2::DOUBLE WHEN 'medium' THEN 1 ELSE 0.7::DOUBLE END) + 0.25::DOUBLE * ln(1 + recall_count::DOUBLE) / ln(11::DOUBLE), 9) AS priority FROM c WHERE created_at_ts >= now - 6 * 3600 AND record_type <> 'gap') ORDER BY priority DESC, seq LIMIT 7""",
)
def replay_batch(spark, sf):
    """Gaps play what was consolidated before."""
    f = T.findings(spark, sf).withColumn("record_type", F.when(F.col("record_type") == "gap", "consolidated").otherwise(F.col("record_type")))
    return W.replay_batch(f, T.EPOCH + 100 * T.STEP).select("id", "priority")


@query("embedding_drift", f"WITH {VECTORS_SQL}, c AS (SELECT CASE WHEN vec_id % 4 = 0 THEN list_cosine_similarity(vec, list_transform(vec, lambda x, i: CASE WHEN i = 1 THEN x + 1 ELSE x END)) ELSE 1 END AS c FROM vectors) SELECT round(avg(c), 6) AS mean_cosine, round(1 - avg(c), 6) AS drift_score, count(*) FILTER (c < 0.95) AS n_drifted, count(*) AS n_texts, 1 - avg(c) > 0.05 AS exceeded FROM c")
def embedding_drift(spark, sf):
    """All vectors as anchors; every fourth has moved along its first axis."""
    v = _base(spark, sf).select("id", "vec")
    moved = v.select("id", F.when(F.col("id") % 4 == 0, F.transform("vec", lambda x, i: F.when(i == 0, x + 1).otherwise(x))).otherwise(F.col("vec")).alias("vec"))
    r = lambda c: F.round(c, 6).alias(c)
    return W.drift(v, moved).select(r("mean_cosine"), r("drift_score"), "n_drifted", "n_texts", "exceeded")


@query("entity_lookup_in_case", "SELECT DISTINCT 'f' || doc_id AS id, source AS investigation_id FROM documents WHERE source = 'src2' AND doc_id % 11 = 3 ORDER BY doc_id DESC LIMIT 5")
def entity_lookup_in_case(spark, sf):
    m = T.findings(spark, sf).select("id", "investigation_id", "created_at_ts", F.when(F.col("seq") % 11 == 3, "Gateway").otherwise("other").alias("entity"))
    return W.lookup_in(m, "gateway", "src2", 5)


@query("tier_moves", f"WITH {FINDINGS_SQL} SELECT id, tier, CASE tier WHEN 'cold' THEN 'warm' ELSE 'hot' END AS promoted, CASE tier WHEN 'hot' THEN 'warm' ELSE 'cold' END AS demoted FROM findings")
def tier_moves(spark, sf):
    return T.findings(spark, sf).select("id", "tier", W.tier_moved(F.col("tier"), True).alias("promoted"), W.tier_moved(F.col("tier"), False).alias("demoted"))


@query("triple_insert", f"WITH {FINDINGS_SQL} SELECT subject, predicate, count(*) AS n, min(created_at_ts) AS first FROM (SELECT DISTINCT investigation_id AS subject, record_type AS predicate, tier AS object, min(created_at_ts) FILTER (seq % 2 = 0) OVER w AS a, min(created_at_ts) FILTER (seq % 2 = 1) OVER w AS b FROM findings WINDOW w AS (PARTITION BY investigation_id, record_type, tier)) t, LATERAL (SELECT coalesce(a, b) AS created_at_ts) GROUP BY 1, 2")
def triple_insert(spark, sf):
    """Triples of even findings are in the store, those of odd ones come in."""
    t = T.findings(spark, sf).select("seq", F.col("investigation_id").alias("subject"), F.col("record_type").alias("predicate"), F.col("tier").alias("object"), "created_at_ts")
    key = ["subject", "predicate", "object"]
    store = t.where("seq % 2 = 0").groupBy(*key).agg(F.min("created_at_ts").alias("created_at_ts"))
    return W.triples_added(store, t.where("seq % 2 = 1").drop("seq")).groupBy("subject", "predicate").agg(F.count("*").alias("n"), F.min("created_at_ts").alias("first"))


@query("recurring_traces", "SELECT event_type AS kind, event_type || ' for user <n>' AS signature, count(*) AS count, max(event_id) AS last FROM events WHERE event_type IN ('error', 'view') GROUP BY 1, 2 HAVING count(*) >= 2")
def recurring_traces(spark, sf):
    log = read_table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.concat("event_type", F.lit(" for user "), F.col("user_id").cast("string")).alias("text"), F.col("event_id").alias("ts"))
    return W.recurring_traces(log, ("error", "view"))


@query("keyword_ratio", "SELECT doc_id, (contains(lower(text), 'the')::INT + contains(lower(text), 'und')::INT + contains(lower(text), 'password')::INT) / 3::DOUBLE AS ratio FROM documents")
def keyword_ratio(spark, sf):
    from strataq.operators import metrics as M

    return read_table(spark, sf, "documents").select("doc_id", M.keyword_ratio(F.col("text"), ("The", "und", "PASSWORD")).alias("ratio"))


@query(
    "graph_fact_lines",
    """WITH r AS (SELECT DISTINCT l_partkey AS symbol, l_orderkey AS finding FROM lineitem), c AS (SELECT symbol, count(*) AS findings FROM r GROUP BY 1), p AS (SELECT DISTINCT ps.l_partkey AS symbol, ps.l_suppkey AS caller FROM lineitem ps), n AS (SELECT symbol, count(*) AS callers, list_sort(list(caller)) AS l FROM p GROUP BY 1)
    SELECT symbol, symbol || ' has ' || callers || ' callers and ' || findings || ' findings. Seen with ' || array_to_string(l[1:4], ', ') || '.' AS line FROM c JOIN n USING (symbol)""",
)
def graph_fact_lines(spark, sf):
    """Suppliers play a part's callers."""
    r = T.refers_to(spark, sf).groupBy("symbol").agg(F.count("*").alias("findings"))
    p = read_table(spark, sf, "lineitem").select(F.col("l_partkey").alias("symbol"), F.col("l_suppkey").alias("caller")).distinct()
    n = p.groupBy("symbol").agg(F.count("*").alias("callers"), F.transform(F.array_sort(F.collect_list("caller")), lambda x: x.cast("string")).alias("related"))
    return W.fact_lines(r.join(n, "symbol"))


@query(
    "gated_sweep",
    f"""WITH {FINDINGS_SQL}, {_VERDICTS_SQL}, e AS (SELECT id AS src, derived_from AS dst FROM findings WHERE derived_from IN (SELECT id FROM findings)), n AS (SELECT id FROM findings WHERE id IN (SELECT src FROM e UNION SELECT dst FROM e) AND seq % 9 <> 4)
    SELECT 'edges' AS part, count(*) AS n FROM e UNION ALL SELECT 'nodes', count(*) FROM n UNION ALL SELECT 'verdicts', count(DISTINCT signature) FROM v""",
)
def gated_sweep(spark, sf):
    """Findings as nodes, derivations as edges; every ninth loses to a near duplicate."""
    f = T.findings(spark, sf)
    v = f.select(W.verdict_signature(F.col("record_type"), F.col("text")).alias("signature"), F.col("importance").alias("confidence"), F.col("created_at_ts").alias("last_seen"))
    edges = f.where("derived_from IS NOT NULL").select(F.col("id").alias("src"), F.col("derived_from").alias("dst"))
    parts = W.swept(v, edges, f.select("id"), f.where("seq % 9 = 4").select("id"), 2, 200)
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])
