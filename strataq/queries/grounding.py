"""Queries on hybrid search, grounding and self-checks.

The query set are the claims whose id is divisible by 50; the embedding of claim i, and of document i, is row i of ``embeddings``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.functions import scoring as S
from strataq.functions import text as X
from strataq.operators import folds as O
from strataq.operators import grounding as G
from strataq.operators import pairs as P
from strataq.operators import retrieval as R
from strataq.operators import services as V
from strataq.operators.overlaps import coded
from strataq.plans import tables as T
from strataq.plans.tables import FINDINGS_SQL, NOW, RESOLUTIONS_SQL, RETRACTIONS_SQL, VECTORS_SQL
from strataq.queries.base import query
from strataq.queries.folds import _GONE, _OVERRIDES
from strataq.queries.retrieval import _queries, _rounded, _worded
from strataq.queries.texts import NEGATED_SQL, TOKENS_SQL
from strataq.storage import discard, materialize, read_table


def _dense_sides(spark, sf, claims=True):
    v = T.vectors(spark, sf)
    q = v.where("vec_id % 50 = 0")
    if claims:
        q = q.join(T.claims(spark, sf).select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    return q.select(F.col("vec_id").alias("query"), "vec"), v.select(F.col("vec_id").alias("id"), "vec")


def _dense(spark, sf, least=None, claims=True):
    return R.vector_scores(*_dense_sides(spark, sf, claims), least, places=6)


def _bm25(spark, sf):
    return _rounded(R.bm25(_queries(spark, sf), _worded(spark, sf)))


def _lexical(spark, sf):
    docs = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.tokens(F.col("text")).alias("tokens"))
    return R.lexical_scores(_queries(spark, sf), docs).withColumn("score", F.round("score", 9))


_Q_SQL = f"q AS (SELECT item_id AS query, text AS q_text, {TOKENS_SQL('text')} AS qt FROM benchmark WHERE item_id % 50 = 0)"
_DENSE_SQL = f"{VECTORS_SQL}, dense AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_cosine_similarity(a.vec, b.vec), 6) AS score FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (SELECT query FROM q))"
_BM25_SQL = """words AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9._:/-]{2,}') AS w FROM documents), qtok AS (SELECT query, unnest(qt) AS token FROM q),
  tf AS (SELECT token, id, length, count(*) AS tf FROM (SELECT id, len(w) AS length, unnest(w) AS token FROM words) WHERE token IN (SELECT token FROM qtok) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
  bm25 AS (SELECT query, id, round(sum(ln(1 + ((SELECT count(*) FROM words) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / 200))), 6) AS score FROM tf JOIN df USING (token) JOIN qtok USING (token) GROUP BY 1, 2)"""
_LEX_SQL = f"docs AS (SELECT doc_id AS id, {TOKENS_SQL('text')} AS t FROM documents), lex AS (SELECT query, id, round(len(list_intersect(qt, t)) / len(qt), 9) AS score FROM q, docs WHERE len(list_intersect(qt, t)) > 0)"
_TOP = lambda name, k: f"(SELECT query, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM {name}) WHERE place <= {k})"
_FUSED = lambda a, b, k: f"fused AS (SELECT query, id, round(sum(1.0::DOUBLE / (60 + place)), 9) AS score FROM (SELECT * FROM {_TOP(a, k)} UNION ALL SELECT * FROM {_TOP(b, k)}) GROUP BY 1, 2)"


@query("rrf_fusion", f"WITH {_Q_SQL}, {_DENSE_SQL}, {_BM25_SQL}, {_FUSED('dense', 'bm25', 20)} SELECT * FROM {_TOP('fused', 10)}")
def rrf_fusion(spark, sf):
    """Dense and BM25 rankings."""
    fused = R.rrf([R.knn(*_dense_sides(spark, sf), 20, places=6), R.top_k(_bm25(spark, sf), 20)]).withColumn("score", F.round("score", 9))
    return R.top_k(fused, 10)


@query("judge_pools", f"WITH {_Q_SQL}, {_DENSE_SQL}, {_BM25_SQL}, {_LEX_SQL} SELECT DISTINCT query, id FROM (SELECT * FROM {_TOP('dense', 10)} UNION ALL SELECT * FROM {_TOP('bm25', 10)} UNION ALL SELECT * FROM {_TOP('lex', 10)})")
def judge_pools(spark, sf):
    """What dense, BM25 and lexical search rank among their first ten."""
    q, docs = _queries(spark, sf), _worded(spark, sf)
    held = R.query_postings(q, docs)
    lexical = R.lexical_of(q, held).withColumn("score", F.round("score", 9))
    found = [R.knn(*_dense_sides(spark, sf), 10, places=6), R.top_k(_rounded(R.bm25_of(q, held, docs)), 10), R.top_k(lexical, 10)]
    lanes = [x.select("query", "id", "place") for x in found]
    return V.judge_pools(lanes[0].unionByName(lanes[1]).unionByName(lanes[2]), 10)


@query("evidence_precheck", f"WITH {_Q_SQL}, {_DENSE_SQL}, {_LEX_SQL}, u AS (SELECT query, id, score, 1 AS lane FROM {_TOP('(SELECT * FROM lex WHERE score >= 0.25)', 10)} UNION ALL SELECT query, id, score, 2 FROM dense WHERE score >= 0.5) SELECT query, id, arg_min(score, (lane, score)) AS score, CASE min(lane) WHEN 1 THEN 'lexical' ELSE 'semantic' END AS lane FROM u GROUP BY 1, 2")
def evidence_precheck(spark, sf, lexical=True):
    """Without the lexical lane, for a store of vectors alone, these are the queries."""
    if not lexical:
        semantic = _dense(spark, sf, 0.4, claims=False)
        return V.precheck(semantic.limit(0), semantic, 0.25)
    return V.precheck(_lexical(spark, sf), _dense(spark, sf, 0.4), 0.25)


@query(
    "hybrid_search",
    f"""WITH {_Q_SQL}, {_DENSE_SQL}, {_BM25_SQL}, docs AS (SELECT doc_id AS id, {TOKENS_SQL('text')} AS t FROM documents), ok AS (SELECT doc_id AS id FROM documents WHERE doc_id % 3 > 0), d AS (SELECT * FROM dense WHERE id IN (SELECT id FROM ok)), b AS (SELECT * FROM bm25 WHERE id IN (SELECT id FROM ok)),
    {_FUSED('d', 'b', 50)}, hits AS (SELECT * FROM {_TOP('fused', 25)}), ce AS (SELECT query, id, coalesce(round(len(list_intersect(qt, t)) / len(qt), 9), 0) AS score FROM hits JOIN q USING (query) LEFT JOIN docs USING (id)) SELECT * FROM {_TOP('ce', 5)}""",
)
def hybrid_search(spark, sf):
    """Findings of medium confidence or more by dense and BM25 ranks, 25 of them reranked by the share of the claim's tokens they hold."""
    found = T.findings(spark, sf).select(F.col("seq").alias("id"), "confidence", "text")
    dense, sparse = (G.with_floor(x, found, "Medium") for x in (_dense(spark, sf), _bm25(spark, sf)))
    texts, asked = found.select("id", X.tokens(F.col("text")).alias("tokens")), _queries(spark, sf).withColumnRenamed("tokens", "qt")
    share = F.round(F.size(F.array_intersect("qt", "tokens")) / F.size("qt"), 9)
    return G.hybrid(dense, sparse, 5, share, texts, asked=asked)


@query(
    "cascade_search",
    f"""WITH {_Q_SQL}, {_DENSE_SQL}, {_LEX_SQL}, {FINDINGS_SQL}, {RESOLUTIONS_SQL}, {_OVERRIDES}, {RETRACTIONS_SQL}, {_GONE}, p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM dense WHERE score >= 0.25), p1 AS (SELECT * FROM p WHERE place <= 30), n AS (SELECT query, count(*) AS n FROM p1 GROUP BY 1),
    m AS (SELECT l.*, row_number() OVER (PARTITION BY l.query ORDER BY l.score DESC, l.id) AS place, coalesce(n, 0) AS n FROM lex l LEFT JOIN n USING (query) WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.query = l.query AND p1.id = l.id)), h AS (SELECT query, id, score FROM p1 UNION ALL SELECT query, id, score FROM m WHERE place <= 30 - n),
    texts AS (SELECT DISTINCT investigation_id, trim(text, ' ') AS t FROM findings JOIN gone ON id = finding_id WHERE trim(text, ' ') <> ''),
    live AS (SELECT f.*, coalesce(override, 'open') AS resolution FROM findings f LEFT JOIN overrides o ON o.finding_id = f.id WHERE f.id NOT IN (SELECT finding_id FROM gone) AND NOT EXISTS (SELECT 1 FROM texts x WHERE x.investigation_id = f.investigation_id AND x.t = trim(f.text, ' ')) AND confidence IN ('medium', 'high')),
    k AS (SELECT h.query, l.id, h.score, row_number() OVER (PARTITION BY h.query, l.investigation_id, l.record_type, substr(l.text, 1, 220) ORDER BY h.score DESC, l.id) AS n FROM h JOIN live l ON l.seq = h.id)
    SELECT query, id, score, place FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM k WHERE n = 1) WHERE place <= 10""",
)
def cascade_search(spark, sf):
    """Dense hits, filled up by lexical ones; then retractions, the confidence floor and an unknown resolution, which is no filter."""
    f = T.findings(spark, sf)
    hits = G.cascade(_dense(spark, sf, 0.24).where("score >= 0.25"), _lexical(spark, sf), 30)
    hits = hits.select("query", F.concat(F.lit("f"), F.col("id").cast("string")).alias("id"), "score")
    out = V.search(hits, f, O.retracted_ids(T.retraction_log(spark, sf)), O.resolution_overrides(T.resolution_log(spark, sf)), "medium", "any")
    return out.select("query", "id", "score", "place")


_EXPANDED_SQL = "list_filter(list_transform(list_concat([{t}], string_split({t}, '.')), lambda x: trim(x)), lambda x: x <> '')"


@query("query_expansion_cleaning", f"WITH e AS (SELECT item_id, {_EXPANDED_SQL.format(t='text')} AS l FROM benchmark) SELECT item_id, unnest(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)[1:5]) AS query FROM e")
def query_expansion_cleaning(spark, sf):
    return _expanded(T.claims(spark, sf).withColumnRenamed("item_id", "query")).select(F.col("query").alias("item_id"), F.col("sub").alias("query"))


def _expanded(claims):
    """(query, place, sub): a claim and up to four of its sentences as searches."""
    return claims.select("query", F.posexplode(R.clean_expansions(F.col("text"), F.split("text", "[.]"), 4)).alias("place", "sub"))


@query(
    "context_search",
    f"""WITH {_Q_SQL}, e AS (SELECT query, {_EXPANDED_SQL.format(t='q_text')} AS l FROM q), x AS (SELECT query, unnest(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)[1:5]) AS sub FROM e), xt AS (SELECT query, {TOKENS_SQL('sub')} AS st FROM x),
    texts AS (SELECT 'main' AS origin, 'f' || doc_id AS id, text, source AS title, {T.EPOCH} + doc_id * {T.STEP} AS born, {TOKENS_SQL('text')} AS t FROM documents UNION ALL SELECT 'chunks', 'c' || conv_id || ':' || turn, text, role, NULL, {TOKENS_SQL('text')} FROM conversations),
    b AS (SELECT query, origin, id, max(round(len(list_intersect(st, t)) / len(st), 9)) AS score FROM xt, texts WHERE len(list_intersect(st, t)) > 0 GROUP BY 1, 2, 3),
    a AS (SELECT query, origin, id, text, title, t, CASE WHEN origin = 'main' THEN round(score * exp(-0.007::DOUBLE * greatest(({NOW} - born)::DOUBLE / 86400, 0)), 4) ELSE score END AS score FROM b JOIN texts USING (origin, id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, origin, id) AS place FROM a), c AS (SELECT r.*, CASE WHEN place <= 20 THEN round(len(list_intersect(qt, t)) / len(qt), 9) END AS ce FROM r JOIN q USING (query) WHERE place <= 300),
    s AS (SELECT query, origin, id, score, text, title, row_number() OVER (PARTITION BY query ORDER BY ce DESC NULLS LAST, place) AS place FROM c), w AS (SELECT *, sum(length('[SOURCE ' || place || ']' || chr(10) || 'Title: ' || title || chr(10) || text || chr(10) || '---' || chr(10))) OVER (PARTITION BY query ORDER BY place) AS total_chars FROM s),
    o AS (SELECT *, max((total_chars > 6000 AND place > 1)::INT) OVER (PARTITION BY query ORDER BY place) AS over_, max((total_chars > 6000 AND place > 1)::INT) OVER (PARTITION BY query)::BOOLEAN AS truncated FROM w)
    SELECT query, place::INT AS place, origin, id, score, total_chars::BIGINT AS total_chars, truncated FROM o WHERE over_ = 0""",
)
def context_search(spark, sf):
    """Claims with their sentences as expansions, over findings, whose scores decay, and conversation turns; reranked against the claim itself."""
    claims = T.claims(spark, sf).where("item_id % 50 = 0").withColumnRenamed("item_id", "query")
    subs = _expanded(claims).select("query", "place", X.tokens(F.col("sub")).alias("tokens"))
    main = T.findings(spark, sf).select(F.lit("main").alias("origin"), "id", "text", F.col("investigation_id").alias("title"), "created_at_ts")
    turns = read_table(spark, sf, "conversations").select(F.lit("chunks").alias("origin"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id"), "text", F.col("role").alias("title"), F.lit(None).cast("long").alias("created_at_ts"))
    texts = main.unionByName(turns)
    key = F.struct(F.col("query").alias("query"), F.col("place").alias("place"))
    scores = R.lexical_scores(subs.select(key.alias("query"), "tokens"), texts.select(F.struct("origin", "id").alias("id"), X.tokens(F.col("text")).alias("tokens")))
    hits = scores.select(F.col("query.query").alias("query"), F.col("id.origin").alias("origin"), F.col("id.id").alias("id"), F.round("score", 9).alias("score"))
    qt = F.broadcast(_queries(spark, sf).select("query", F.col("tokens").alias("qt")))
    share = F.round(F.size(F.array_intersect("qt", X.tokens(F.col("text")))) / F.size("qt"), 9)
    out = G.context(hits.join(qt.select("query"), "query", "left_semi"), texts, NOW, share, extra=qt)
    return out.select("query", "place", "origin", "id", "score", "total_chars", "truncated")


_MEM = "list_filter(list_distinct(list_transform(regexp_extract_all({t}, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda x: lower(x))), lambda x: length(x) >= 4)"
_STOP_SQL = ", ".join(f"'{w}'" for w in G.MEMORY_STOP)


@query(
    "memory_selection",
    f"""WITH t AS (SELECT item_id AS task, list_filter({_MEM.format(t='text')}, lambda x: x NOT IN ({_STOP_SQL})) AS a FROM benchmark WHERE item_id % 50 = 0), e AS (SELECT 'm' || doc_id AS entry, {_MEM.format(t='text')} AS b FROM documents),
    s AS (SELECT task, entry, list_intersect(a, b) AS c FROM t, e), w AS (SELECT task, entry, list_sum(list_transform(c, lambda x: CASE WHEN length(x) >= 7 THEN 2 ELSE 1 END))::BIGINT AS weight FROM s WHERE len(c) >= 2 AND len(list_filter(c, lambda x: length(x) >= 7)) > 0)
    SELECT task, entry, weight FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY weight DESC, entry DESC) AS n FROM w) WHERE n <= 2""",
)
def memory_selection(spark, sf):
    tasks = T.claims(spark, sf).where("item_id % 50 = 0").select(F.col("item_id").alias("task"), "text")
    return G.memory_entries(tasks, T.findings(spark, sf).select(F.concat(F.lit("m"), F.col("seq").cast("string")).alias("entry"), "text"))


@query("grounding_blocks", None)
def grounding_blocks(spark, sf):
    """Per investigation its brief, three latest findings, what is resolved, and its two fitting memory entries, within 4000 characters."""
    f = T.findings(spark, sf)
    lane = lambda df, place, tag, text, share: df.select(F.col("investigation_id").alias("task"), F.lit(place).alias("place") if isinstance(place, int) else place.alias("place"), tag.alias("tag"), text.alias("text"), F.lit(share).alias("share"))
    case = F.concat(F.lit("case:"), "investigation_id")
    last = O.last_n(f, ["investigation_id"], "seq", 3)
    done = f.join(O.resolution_overrides(T.resolution_log(spark, sf)).where("override IN ('fixed', 'wontfix')"), F.col("id") == F.col("finding_id"))
    known = O.last_n(done, ["investigation_id"], "seq", 12).groupBy("investigation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat(F.lit("["), "override", F.lit("] "), F.substring("text", 1, 180)).alias("t")))), lambda x: x["t"]), " • ").alias("t"))
    lanes = lane(V.summaries(f), 1, case, F.col("line"), 0.12).unionByName(lane(last, F.row_number().over(_latest()) + 1, F.concat(case, F.lit(":finding")), F.col("text"), 0.08)).unionByName(lane(known, 9, F.lit("known"), F.col("t"), 0.15))
    return G.lanes_block(lanes)


def _latest():
    from pyspark.sql.window import Window

    return Window.partitionBy("investigation_id").orderBy("seq")


_SETS_SQL = f"sets AS (SELECT doc_id AS seq, 'f' || doc_id AS id, source, ['observed', 'inferred', 'assumed', 'gap'][1 + doc_id % 4] AS record_type, ['low', 'medium', 'high'][1 + doc_id % 3] AS confidence, {TOKENS_SQL('text')} AS t, {NEGATED_SQL('text')} AS n FROM documents)"
_WEIGHT_SQL = "least(1, CASE {c}.confidence WHEN 'high' THEN 0.9::DOUBLE WHEN 'medium' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END * CASE {c}.record_type WHEN 'observed' THEN 1.1::DOUBLE WHEN 'inferred' THEN 1 WHEN 'assumed' THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END)"
_CLASH_SQL = f"""{_SETS_SQL}, clash AS (SELECT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b, a.source AS inv_a, b.source AS inv_b, greatest({_WEIGHT_SQL.format(c='a')}, {_WEIGHT_SQL.format(c='b')}) >= 0.75 AS provisional
  FROM sets a JOIN sets b ON a.seq < b.seq AND a.n <> b.n AND len(a.t) > 0 AND len(b.t) > 0 AND len(list_intersect(a.t, b.t)) >= 0.5 * least(len(a.t), len(b.t)) - 1e-9)"""


@query("contradiction_pairs", f"WITH {_CLASH_SQL} SELECT id_a, id_b, provisional, CASE WHEN provisional THEN 0.40 ELSE 0.55 END::DOUBLE AS confidence FROM clash")
def contradiction_pairs(spark, sf):
    return P.contradictions(T.findings(spark, sf), X.tokens(F.col("text")), X.is_negated(F.col("text")))


@query("jaccard_pairs", "WITH w AS (SELECT doc_id AS id, list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n]+'), lambda w: w <> '')) AS w FROM documents), j AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS c, len(a.w) AS n, len(b.w) AS m FROM w a JOIN w b ON a.id < b.id AND len(a.w) > 0 AND len(b.w) > 0 AND len(a.w) * 0.8 <= len(b.w) + 1e-9 AND len(b.w) * 0.8 <= len(a.w) + 1e-9) SELECT a, b, round(c / (n + m - c), 9) AS jaccard FROM j WHERE c / (n + m - c) >= 0.8 - 1e-12")
def jaccard_pairs(spark, sf):
    words = F.array_distinct(F.array_remove(F.split(F.lower("text"), "[ \\t\\n]+"), ""))
    return P.jaccard_join(read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), words.alias("tokens")), 0.8).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


@query("provenance_gaps", f"WITH {_SETS_SQL} SELECT id FROM sets f WHERE record_type = 'observed' AND len(t) > 0 AND NOT EXISTS (SELECT 1 FROM sets r WHERE r.record_type = 'inferred' AND r.source = f.source AND len(list_intersect(f.t, r.t)) >= 0.45 * len(f.t) - 1e-9)")
def provenance_gaps(spark, sf):
    f = T.findings(spark, sf).where("record_type IN ('observed', 'inferred')")
    f = materialize(f.select("id", "record_type", X.tokens(F.col("text")).alias("tokens"), F.col("investigation_id").alias("source")), "gap-sets")
    receipts = f.where("record_type = 'inferred'").select("id", "tokens", F.array("source").alias("names"))
    return P.unsupported(f.where("record_type = 'observed' AND size(tokens) > 0"), receipts)


_LOST_SQL = "lost AS (SELECT id FROM sets f WHERE record_type IN ('observed', 'inferred') AND NOT EXISTS (SELECT 1 FROM sets r WHERE r.record_type IN ('assumed', 'gap') AND len(f.t) > 0 AND len(r.t) > 0 AND len(list_intersect(f.t, r.t)) >= greatest(0.45 * len(f.t) - 1e-9, 1)))"


def _tallies_and_lost(spark, sf, same=None):
    f = T.findings(spark, sf)
    sets = f.select("id", "investigation_id", "record_type", X.tokens(F.col("text")).alias("tokens"), X.is_negated(F.col("text")).alias("negated"), F.lit("").alias("group"), F.lit(0).alias("mark"))
    sets = materialize(sets, "check-sets")
    # Both questions meet the same sets, so their words are counted and coded once.
    codes, _ = coded(sets, more=("investigation_id", "record_type", "negated"))
    side = lambda kinds: codes.where(f"record_type IN ({kinds})").select("id", "group", "mark", "size", "code")
    met = P.covered(side("'observed', 'inferred'"), side("'assumed', 'gap'"), 0.45)
    lost = sets.where("record_type IN ('observed', 'inferred')").select("id").join(met, "id", "left_anti")
    lost = materialize(lost, "unsupported")
    discard(sets)
    tallies = P.contradiction_counts(codes, None, F.col("negated"), lost, same=same)
    discard(codes)
    return f, tallies, lost


@query("hallucination_candidates", f"WITH {_CLASH_SQL}, {_LOST_SQL}, s AS (SELECT id_a AS id, id_b AS other FROM clash UNION ALL SELECT id_b, id_a FROM clash) SELECT DISTINCT id FROM s WHERE id IN (SELECT id FROM lost) AND other NOT IN (SELECT id FROM lost)")
def hallucination_candidates(spark, sf):
    return V.hallucination_candidates(_tallies_and_lost(spark, sf)[1])


@query(
    "self_check_counts",
    f"""WITH {_CLASH_SQL}, {_LOST_SQL}, own AS (SELECT * FROM clash WHERE inv_a = inv_b), s AS (SELECT id_a AS id, id_b AS other FROM own UNION ALL SELECT id_b, id_a FROM own), h AS (SELECT DISTINCT id FROM s WHERE id IN (SELECT id FROM lost) AND other NOT IN (SELECT id FROM lost)),
    r AS (SELECT source AS investigation_id, 'u' AS kind FROM lost JOIN sets USING (id) UNION ALL SELECT inv_a, 'c' FROM own UNION ALL SELECT source, 'h' FROM h JOIN sets USING (id) UNION ALL SELECT DISTINCT source, 'f' FROM sets)
    SELECT investigation_id, count(*) FILTER (kind = 'u') AS unsupported, count(*) FILTER (kind = 'c') AS contradictions, count(*) FILTER (kind = 'h') AS candidates FROM r GROUP BY ROLLUP (investigation_id)""",
)
def self_check_counts(spark, sf):
    f, tallies, lost = _tallies_and_lost(spark, sf, "investigation_id")
    return G.self_check(f.select("id", "investigation_id"), tallies, lost)


_AUDIT_SQL = "audit AS (SELECT event_id, 'src' || (user_id % 5) AS investigation_id, event_type AS tool, 'user ' || user_id AS inputs, 'value ' || event_id || ' of ' || event_type || ' and more output' AS output FROM events)"


@query(
    "validation_evidence",
    f"""WITH {_AUDIT_SQL}, e AS (SELECT 'f' || doc_id AS evidence_id, ['observed', 'inferred', 'assumed', 'gap'][1 + doc_id % 4] AS record_type, source, text, 'findings' AS origin, text AS shown FROM documents WHERE source = 'src1' AND doc_id % 3 > 0
      UNION ALL SELECT 'e' || event_id, 'audit', tool, tool || ' ' || inputs || ' ' || output, 'audit', output FROM audit WHERE investigation_id = 'src1' AND event_id % 2 = 0 UNION ALL SELECT 'audit:' || tool || ':' || event_id, 'audit', tool, tool || ' ' || inputs || ' ' || output, 'recent audit', output FROM audit WHERE investigation_id = 'src1' AND event_id % 2 = 1)
    SELECT evidence_id, record_type, source, substr(trim(replace(shown, chr(10), ' '), ' '), 1, 260) AS snippet, len({TOKENS_SQL('text')}) AS n_tokens, origin FROM e""",
)
def validation_evidence(spark, sf):
    f = T.findings(spark, sf).where("investigation_id = 'src1'").select("id", "record_type", F.col("investigation_id").alias("source"), "text", "confidence")
    i = F.col("event_id").cast("string")
    audit = read_table(spark, sf, "events").select("event_id", F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("investigation_id"), F.col("event_type").alias("tool"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("inputs"), F.concat(F.lit("value "), i, F.lit(" of "), "event_type", F.lit(" and more output")).alias("output"), i.alias("ts"))
    scoped = audit.where("investigation_id = 'src1' AND event_id % 2 = 0").withColumn("id", F.concat(F.lit("e"), "ts"))
    recent = audit.where("event_id % 2 = 1").withColumn("id", F.lit(None).cast("string"))
    out = G.evidence(f, scoped, recent, "medium", "src1")
    return out.select("evidence_id", "record_type", "source", "snippet", F.size("tokens").alias("n_tokens"), "origin")
