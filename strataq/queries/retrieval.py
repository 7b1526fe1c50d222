"""Queries on retrieval, fusion, ranking and context assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.functions import scoring as S
from strataq.functions import text as X
from strataq.operators import grounding as G
from strataq.operators import retrieval as R
from strataq.operators import windows as W
from strataq.operators.cells import VectorIndex
from strataq.operators.nearest import near_pairs
from strataq.operators.postings import InvertedIndex
from strataq.plans import tables as T
from strataq.plans.tables import FINDINGS_SQL, NOW, VECTORS_SQL
from strataq.queries.base import query
from strataq.queries.texts import TOKENS_SQL
from strataq.storage import new_path, read_table


def _queries(spark, sf):
    """The stated query set of searches: claims whose id is divisible by 50, here and in the SQL."""
    return T.claims(spark, sf).where("item_id % 50 = 0").select(F.col("item_id").alias("query"), X.tokens(F.col("text")).alias("tokens"))


def _vector_queries(spark, sf):
    return T.vectors(spark, sf).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "vec", F.col("label").alias("q_label"))


def _base(spark, sf):
    return T.vectors(spark, sf).withColumnRenamed("vec_id", "id")


_LEXICAL_SQL = f"""{FINDINGS_SQL}, q AS (SELECT item_id AS query, {TOKENS_SQL('text')} AS qt FROM benchmark WHERE item_id % 50 = 0),
  s AS (SELECT query, id, seq, investigation_id, text, len(list_intersect(qt, {TOKENS_SQL('text')})) / len(qt) AS score FROM q, findings),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM s WHERE score > 0)"""


@query(
    "lexical_topk_context",
    f"""WITH {_LEXICAL_SQL}, b AS (SELECT *, '[SOURCE ' || place || ']' || chr(10) || 'Title: ' || investigation_id || chr(10) || text || chr(10) || '---' || chr(10) AS block FROM ranked WHERE place <= 10),
    r AS (SELECT *, sum(length(block)) OVER (PARTITION BY query ORDER BY place) AS total_chars FROM b),
    o AS (SELECT *, max((total_chars > 6000 AND place > 1)::INT) OVER (PARTITION BY query ORDER BY place) AS over_, max((total_chars > 6000 AND place > 1)::INT) OVER (PARTITION BY query)::BOOLEAN AS truncated FROM r)
    SELECT query, place::INT AS place, id, round(score, 9) AS score, total_chars::BIGINT AS total_chars, truncated FROM o WHERE over_ = 0""",
)
def lexical_topk_context(spark, sf):
    f = T.findings(spark, sf)
    hits = R.top_k(R.lexical_scores(_queries(spark, sf), f.select("id", X.tokens(F.col("text")).alias("tokens"))), 10)
    full = hits.join(f.select("id", "text", "investigation_id"), "id")
    return R.assemble_context(full, F.col("text"), F.col("investigation_id")).select("query", "place", "id", F.round("score", 9).alias("score"), "total_chars", "truncated")


_ALL_SQL = lambda t: f"list_filter(regexp_extract_all(lower({t}), '[a-z0-9][a-z0-9._:/-]{{2,}}'), lambda x: TRUE)"


_BM25_SQL = (f"""WITH q AS (SELECT item_id AS query, unnest({TOKENS_SQL('text')}) AS token FROM benchmark WHERE item_id % 50 = 0), d AS (SELECT doc_id AS id, {_ALL_SQL('text')} AS w FROM documents),
    p AS (SELECT id, len(w) AS length, unnest(w) AS token FROM d), tf AS (SELECT token, id, length, count(*) AS tf FROM p WHERE token IN (SELECT token FROM q) GROUP BY ALL),
    df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), s AS (SELECT query, id, sum(ln(1 + ((SELECT count(*) FROM d) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / 200))) AS score FROM tf JOIN df USING (token) JOIN q USING (token) GROUP BY 1, 2)
    SELECT query, id, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, id) AS place FROM s) WHERE place <= 20""")


@query("bm25_topk", _BM25_SQL)
def bm25_topk(spark, sf):
    return R.top_k(R.bm25(_queries(spark, sf), _worded(spark, sf)).withColumn("score", F.round("score", 6)), 20)


def _worded(spark, sf):
    return read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract_all(F.lower("text"), F.lit(X.TOKEN), F.lit(0)).alias("words"))


@query("bm25_indexed", _BM25_SQL)
def bm25_indexed(spark, sf):
    """The rows of ``bm25_topk`` from a stored index of two segments."""
    index = InvertedIndex(spark, new_path(spark, "postings"))
    for k in (0, 1):
        index.append(_worded(spark, sf).where(F.col("id") % 2 == k))
    return index.search(_queries(spark, sf), 20)


_KNN_SQL = f"{VECTORS_SQL}, s AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_cosine_similarity(a.vec, b.vec), 6) AS score, a.label AS q_label, b.label AS label FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


@query("knn_topk", f"WITH {_KNN_SQL} SELECT query, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM s) WHERE place <= 10")
def knn_topk(spark, sf):
    return R.knn(_vector_queries(spark, sf), _base(spark, sf), 10, places=6)


@query("ann_topk")
def ann_topk(spark, sf):
    """Approximate neighbours from a stored index of two batches; see the README for its recall."""
    index = VectorIndex(spark, new_path(spark, "vector-index"), cells=32)
    for k in (0, 1):
        index.append(_base(spark, sf).where(F.col("id") % 2 == k))
    return _rounded(index.search(_vector_queries(spark, sf), 10, probes=24))


@query("knn_filtered", f"WITH {_KNN_SQL} SELECT query, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM s WHERE label = q_label AND score >= 0.1) WHERE place <= 10")
def knn_filtered(spark, sf):
    return R.knn(_vector_queries(spark, sf).withColumnRenamed("q_label", "label"), _base(spark, sf), 10, 0.1, "label", 6)


@query(
    "session_fan_out",
    f"""WITH {_KNN_SQL}, t AS (SELECT query, CASE id % 3 WHEN 0 THEN 'memory' WHEN 1 THEN 'sessions' ELSE 'archive' END AS store, id, score FROM s WHERE score >= 0.15 AND q_label % 2 = label % 2),
    u AS (SELECT query, store, id, score FROM t UNION ALL SELECT query, 'pinned', id, score FROM t WHERE id % 10 = 0), l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query, store ORDER BY score DESC, id) <= 12),
    one AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY query, id ORDER BY score DESC, store) = 1) SELECT * FROM (SELECT query, store, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM one) WHERE place <= 6""",
)
def session_fan_out(spark, sf):
    """Four stores, of which one holds rows of the others, for rows of the asking agent's kind."""
    base = _base(spark, sf).withColumn("kind", F.col("label") % 2)
    stores = {name: base.where(F.col("id") % 3 == k) for k, name in enumerate(("memory", "sessions", "archive"))} | {"pinned": base.where(F.col("id") % 10 == 0)}
    return R.fan_out(_vector_queries(spark, sf).withColumn("kind", F.col("q_label") % 2), stores, 6, 0.15, "kind")


@query("relevance_gate", f"WITH {_KNN_SQL} SELECT query, count(*) AS n, sum((score >= 0.59 AND place <= 12)::INT)::BIGINT AS kept FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM s) GROUP BY 1")
def relevance_gate(spark, sf):
    return R.vector_gate(_vector_queries(spark, sf), _base(spark, sf), places=6)



@query(
    "entropy_weighted_levels",
    f"""WITH {_KNN_SQL}, b AS (SELECT * FROM (SELECT query, label % 3 + 1 AS level, id, score, row_number() OVER (PARTITION BY query, label % 3 ORDER BY score DESC, id) AS n FROM s) WHERE n <= 5),
    e AS (SELECT *, exp(score - max(score) OVER l) AS e, count(*) OVER l AS c FROM b WINDOW l AS (PARTITION BY query, level)), p AS (SELECT *, e / sum(e) OVER (PARTITION BY query, level) AS p FROM e),
    w AS (SELECT *, CASE WHEN c < 2 THEN 1.0 ELSE 1 / (1 - sum(p * ln(p)) OVER (PARTITION BY query, level)) END AS w FROM p)
    SELECT query, level, id, round(score, 6) AS score, round(w / sum(w / c) OVER (PARTITION BY query), 6) AS weight, round(score * w / sum(w / c) OVER (PARTITION BY query), 6) AS weighted FROM w""",
)
def entropy_weighted_levels(spark, sf):
    hits = near_pairs(_vector_queries(spark, sf), _base(spark, sf).withColumn("level", F.col("label") % 3 + 1), 5, places=6, by="level")
    r = lambda c: F.round(c, 6).alias(c)
    return R.entropy_weighted(hits, 5).select("query", "level", "id", r("score"), r("weight"), r("weighted"))


@query(
    "metamemory_cues",
    f"""WITH {_KNN_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM s), k AS (SELECT * FROM h WHERE place <= 10),
    c AS (SELECT query, max(CASE WHEN place = 1 THEN score END) AS fluency, avg(CASE WHEN place <= 4 THEN score END) AS accessibility, count(DISTINCT label) AS source_div, ln(1 + max(id % 12)::DOUBLE) / ln(21::DOUBLE) AS corroboration, avg(CASE id % 3 WHEN 0 THEN 0.4::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 1 END) AS trust FROM k GROUP BY 1),
    v AS (SELECT *, 1 / (1 + exp(-8 * (0.10::DOUBLE * fluency + 0.20::DOUBLE * accessibility + 0.30::DOUBLE * least(1, source_div / 5) + 0.15::DOUBLE * corroboration + 0.25::DOUBLE * trust - 0.5::DOUBLE))) AS confidence FROM c)
    SELECT query, round(fluency, 6) AS fluency, round(accessibility, 6) AS accessibility, source_div, round(corroboration, 6) AS corroboration, round(trust, 6) AS trust, round(confidence, 6) AS confidence,
      CASE WHEN source_div >= 2 THEN 'recollection' WHEN corroboration > 0.3 THEN 'corroboration' WHEN trust > 0.7 THEN 'trust' ELSE 'familiarity' END AS basis, CASE WHEN confidence >= 0.75 THEN 'confident' WHEN confidence >= 0.5 THEN 'moderate' WHEN confidence >= 0.3 THEN 'low' ELSE 'unreliable' END AS recommendation FROM v""",
)
def metamemory_cues(spark, sf):
    hits = R.knn(_vector_queries(spark, sf), _base(spark, sf), 10, places=6).join(_base(spark, sf).select("id", "label"), "id")
    level = F.element_at(F.array(*map(F.lit, T.CONFIDENCES)), (F.col("id") % 3 + 1).cast("int"))
    cues = R.metamemory_cues(hits.select("query", "place", "score", F.col("label").alias("source"), level.alias("confidence"), (F.col("id") % 12).alias("occurrences")))
    return cues.select("query", "source_div", "basis", "recommendation", *(F.round(c, 6).alias(c) for c in ("fluency", "accessibility", "corroboration", "trust", "confidence")))


@query("keyword_boosted", f"WITH {_LEXICAL_SQL}, k AS (SELECT item_id AS query, list_filter(list_distinct(string_split_regex(lower(text), '[^a-z0-9]+')), lambda x: x <> '') AS kt FROM benchmark WHERE item_id % 50 = 0) SELECT query, id, round(score * importance2 + CASE WHEN len(kt) >= 2 THEN least(0.25, 0.05::DOUBLE * len(list_filter(kt, lambda t: length(t) > 3 AND contains(lower(text), t)))) ELSE 0 END, 9) AS fused FROM ranked JOIN k USING (query) JOIN (SELECT id, importance AS importance2 FROM findings) USING (id) WHERE place <= 50")
def keyword_boosted(spark, sf):
    f = T.findings(spark, sf)
    words = F.filter(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+")), lambda x: x != "")
    keyed = T.claims(spark, sf).where("item_id % 50 = 0").select(F.col("item_id").alias("query"), words.alias("kt"))
    hits = R.top_k(R.lexical_scores(_queries(spark, sf), f.select("id", X.tokens(F.col("text")).alias("tokens"))), 50)
    full = hits.join(f.select("id", "text", "importance"), "id").join(keyed, "query")
    return full.select("query", "id", F.round(F.col("score") * F.col("importance") + S.keyword_boost(F.col("kt"), F.col("text")), 9).alias("fused"))


_MS = "0.5::DOUBLE * (score * importance + CASE WHEN len(kt) >= 2 THEN least(0.25, 0.05::DOUBLE * len(list_filter(kt, lambda t: length(t) > 3 AND contains(lower(text), t)))) ELSE 0 END) + 0.2::DOUBLE * exp(-ln(2::DOUBLE) / 7 * greatest(({now} - created_at_ts)::DOUBLE / 86400, 0)) + 0.15::DOUBLE * CASE confidence WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END + 0.15::DOUBLE * CASE record_type WHEN 'observed' THEN 1.0::DOUBLE WHEN 'inferred' THEN 0.8::DOUBLE WHEN 'assumed' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END + 0.08::DOUBLE * ln(1 + phero)"
_SIM = "coalesce(len(list_intersect({a}.w, {b}.w)) / greatest(len({a}.w), len({b}.w)), 0)"


def _pick(n: int) -> str:
    """The n-th choice of maximal marginal relevance in SQL."""
    sims = [_SIM.format(a="h", b=f"p{i}") for i in range(1, n)]
    value = f"0.75::DOUBLE * h.ms - 0.25::DOUBLE * greatest({', '.join(sims)})" if sims else "h.ms"
    joins = "".join(f" JOIN p{i} ON p{i}.query = h.query AND p{i}.seq <> h.seq" for i in range(1, n))
    return f"p{n} AS (SELECT * EXCLUDE (n) FROM (SELECT h.*, {n} AS place, row_number() OVER (PARTITION BY h.query ORDER BY {value} DESC, h.seq) AS n FROM h{joins}) WHERE n = 1)"


@query(
    "turn_grounding",
    f"""WITH {_LEXICAL_SQL}, k AS (SELECT item_id AS query, list_filter(list_distinct(string_split_regex(lower(text), '[^a-z0-9]+')), lambda x: x <> '') AS kt FROM benchmark WHERE item_id % 50 = 0),
    c AS (SELECT s.query, s.score, f.*, CASE WHEN f.record_type IN ('observed', 'inferred') THEN 'memory' ELSE 'archive' END AS lane FROM s JOIN findings f USING (id) WHERE score > 0),
    t AS (SELECT *, recall_count / 4 AS stored, CASE WHEN seq % 3 = 0 THEN created_at_ts + 86400 END AS since FROM c QUALIFY row_number() OVER (PARTITION BY query, lane ORDER BY score DESC, id) <= 10),
    e AS (SELECT *, CASE WHEN stored <= 0 THEN 0 WHEN since IS NULL THEN stored ELSE stored * exp(-ln(2::DOUBLE) / 24 * (greatest({NOW} - since, 0)::DOUBLE / 3600)) END AS phero FROM t WHERE importance >= 0.2),
    h AS (SELECT query, lane, id, seq, phero, list_filter(list_distinct(string_split_regex(lower(text), '[ \t\n]+')), lambda x: x <> '') AS w, round({_MS.format(now=NOW)}, 9) AS ms FROM e JOIN k USING (query)), {_pick(1)}, {_pick(2)}, {_pick(3)}
    SELECT query, place, lane, id, round(ms, 6) AS score, CASE WHEN lane = 'memory' THEN round(phero + 1, 6) END AS pheromone FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)""",
)
def turn_grounding(spark, sf):
    """Two lanes, ten hits of each, boosted by keywords, without unimportant ones, decayed and reinforced, and three chosen for a turn."""
    f = T.findings(spark, sf)
    tokens = f.select("id", X.tokens(F.col("text")).alias("tokens"))
    lane = F.when(F.col("record_type").isin("observed", "inferred"), "memory").otherwise("archive")
    scores = R.lexical_scores(_queries(spark, sf), tokens).join(f.select("id", lane.alias("lane")), "id")
    best = W.top_per_key(scores, ["query", "lane"], [F.desc("score"), F.asc("id")], 10)
    hits = best.join(f.select("id", F.col("seq").alias("item"), "importance", "text", "confidence", "record_type", "created_at_ts", (F.col("recall_count") / 4).alias("pheromone"), F.when(F.col("seq") % 3 == 0, F.col("created_at_ts") + 86400).alias("reinforced_ts")), "id")
    words = F.filter(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+")), lambda x: x != "")
    keyed = T.claims(spark, sf).where("item_id % 50 = 0").select(F.col("item_id").alias("query"), words.alias("kt"))
    return G.turn_grounding(hits, keyed, NOW).select("query", "place", "lane", "id", F.round("score", 6).alias("score"), F.round("pheromone", 6).alias("pheromone"))


@query("mmr_selection", None)
def mmr_selection(spark, sf):
    f = T.findings(spark, sf)
    hits = R.top_k(R.lexical_scores(_queries(spark, sf), f.select("id", X.tokens(F.col("text")).alias("tokens"))), 30)
    words = F.array_distinct(F.split(F.lower("text"), "[ \\t\\n]+"))
    rows = hits.join(f.select("id", words.alias("words"), "seq"), "id").select("query", "seq", "score", "words")
    return W.greedy_mmr(rows, ["query"], "seq", "score", "words", 3).select("query", "place", "seq", F.round("score", 6).alias("score"))


@query("decayed_context_ranking", f"WITH {_LEXICAL_SQL}, m AS (SELECT r.query, r.id, round(r.score * exp(-0.007::DOUBLE * greatest(({NOW} - f.created_at_ts)::DOUBLE / 86400, 0)), 9) AS score FROM ranked r JOIN findings f USING (id) WHERE r.place <= 40) SELECT query, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM m) WHERE place <= 20")
def decayed_context_ranking(spark, sf):
    f = T.findings(spark, sf)
    hits = R.top_k(R.lexical_scores(_queries(spark, sf), f.select("id", X.tokens(F.col("text")).alias("tokens"))), 40)
    aged = hits.join(f.select("id", "created_at_ts"), "id").select("query", "id", F.round(S.exponential_decay(F.col("score"), F.col("created_at_ts"), NOW), 9).alias("score"))
    return R.top_k(aged, 20)


@query("surface_memories", f"WITH {_LEXICAL_SQL} SELECT query, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM (SELECT r.query, r.id, round(r.score * exp(-0.007::DOUBLE * greatest(({NOW} - f.created_at_ts)::DOUBLE / 86400, 0)), 9) AS score FROM ranked r JOIN findings f USING (id) WHERE r.place <= 30 AND r.score >= 0.25)) WHERE place <= 10")
def surface_memories(spark, sf):
    """Three times as many hits as asked for; the floor holds before ages count."""
    f = T.findings(spark, sf)
    hits = R.top_k(R.lexical_scores(_queries(spark, sf), f.select("id", X.tokens(F.col("text")).alias("tokens"))), 30).where("score >= 0.25")
    aged = hits.join(f.select("id", "created_at_ts"), "id").select("query", "id", F.round(S.exponential_decay(F.col("score"), F.col("created_at_ts"), NOW), 9).alias("score"))
    return R.top_k(aged, 10)


@query("memory_recall_lanes", f"WITH {FINDINGS_SQL}, l AS (SELECT id, 0.8 AS score FROM findings WHERE list_contains(string_split_regex(lower(text), '[^a-z0-9]+'), 'the') AND list_contains(string_split_regex(lower(text), '[^a-z0-9]+'), 'was') UNION ALL SELECT id, 0.75 FROM findings WHERE list_contains(string_split_regex(lower(text), '[^a-z0-9]+'), 'der') UNION ALL SELECT id, 0.6 FROM findings WHERE contains(lower(text), 'tion')) SELECT id, max(score)::DOUBLE AS score FROM l GROUP BY 1")
def memory_recall_lanes(spark, sf):
    f = T.findings(spark, sf)
    lanes = R.word_search(f, ("the", "was"), True, 0.8).union(R.word_search(f, ("der",), True, 0.75)).union(R.word_search(f, ("tion",), False, 0.6))
    return lanes.groupBy("id").agg(F.max("score").alias("score"))



@query("procedure_search", f"WITH {FINDINGS_SQL} SELECT id, recall_count FROM findings WHERE record_type = 'inferred' AND contains(lower(text), 'that') ORDER BY recall_count DESC, seq LIMIT 20")
def procedure_search(spark, sf):
    f = T.findings(spark, sf).where("record_type = 'inferred'").where(F.contains(F.lower("text"), F.lit("that")))
    return f.orderBy(F.desc("recall_count"), "seq").limit(20).select("id", "recall_count")
