"""Queries on evaluation metrics and datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.functions import scoring as S
from strataq.operators import maintenance as D
from strataq.operators import metrics as M
from strataq.operators import retrieval as R
from strataq.plans import tables as T
from strataq.plans.tables import VECTORS_SQL
from strataq.queries.base import query
from strataq.queries.retrieval import _KNN_SQL, _base, _vector_queries
from strataq.storage import read_table


def _rank_metrics(spark, sf):
    """Relevant to a query are all other vectors of its label: they are counted by label, and never listed."""
    ranked = R.knn(_vector_queries(spark, sf), _base(spark, sf), 20, places=6).select("query", "id", "place")
    return M.rank_metrics_by_label(ranked, _vector_queries(spark, sf).select("query", F.col("q_label").alias("label")), _base(spark, sf).select("id", "label"), 10)


_METRICS_SQL = f"""{_KNN_SQL}, ranked AS (SELECT query, id, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM s) WHERE place <= 20), rel AS (SELECT query, id FROM s WHERE label = q_label),
  size AS (SELECT query, count(*) AS n FROM rel GROUP BY 1), hit AS (SELECT query, count(*) FILTER (place <= 10) AS hits, sum(1 / log2(place + 1)) FILTER (place <= 10) AS dcg, min(place) AS first FROM ranked JOIN rel USING (query, id) GROUP BY 1),
  m AS (SELECT query, coalesce(hits / n, 0) AS recall, coalesce(1.0::DOUBLE / first, 0) AS mrr, coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0) AS ndcg FROM size LEFT JOIN hit USING (query))"""


@query("rank_metrics", f"WITH {_METRICS_SQL} SELECT query, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM m")
def rank_metrics(spark, sf):
    r = lambda c: F.round(c, 6).alias(c)
    return _rank_metrics(spark, sf).select("query", r("recall"), r("mrr"), r("ndcg"))


@query("flip_gate", f"WITH {_METRICS_SQL}, a AS (SELECT round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg FROM m), b AS (SELECT recall * 1.05::DOUBLE AS recall, mrr AS mrr, ndcg * 1.05::DOUBLE AS ndcg FROM a), x AS (SELECT (b.ndcg - a.ndcg) / a.ndcg AS rel, b.recall - a.recall < -0.01 OR b.mrr - a.mrr < -0.01 AS worse FROM a, b) SELECT round(rel, 4) AS relative_gain, worse AS regressed, rel >= 0.02 AND NOT worse AS flip FROM x")
def flip_gate(spark, sf):
    base = M.mean_metrics(_rank_metrics(spark, sf))
    better = base.select((F.col("recall") * 1.05).alias("recall"), "mrr", (F.col("ndcg") * 1.05).alias("ndcg"))
    return M.flip_gate(base, better)


@query("proxy_relevance", "SELECT label AS \"group\", count(*) AS size FROM embeddings GROUP BY 1 HAVING count(*) > 1")
def proxy_relevance(spark, sf):
    return M.proxy_relevance(T.vectors(spark, sf).select(F.col("label").alias("group")))


_SCORED_SQL = "scored AS (SELECT quality AS label, round(n_chars % 997 / 997::DOUBLE, 3) AS score FROM labels JOIN documents USING (doc_id))"


def _scored(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", F.round((F.col("n_chars") % 997) / F.lit(997.0), 3).alias("score"))
    return read_table(spark, sf, "labels").join(docs, "doc_id").select(F.col("quality").alias("label"), "score")


@query(
    "gate_auc_f1",
    f"""WITH {_SCORED_SQL}, c AS (SELECT sum((label = 1 AND score >= 0.59)::INT) AS tp, sum((label = 0 AND score >= 0.59)::INT) AS fp, sum((label = 1)::INT) AS pos, sum((label = 0)::INT) AS neg FROM scored),
    u AS (SELECT avg((p.score > n.score)::INT + 0.5 * (p.score = n.score)::INT) AS auc FROM scored p, scored n WHERE p.label = 1 AND n.label = 0)
    SELECT round(tp / pos, 6) AS recall, round((neg - fp) / neg, 6) AS bleed_rejection, round(tp / (tp + fp), 6) AS precision, round(2 * tp / (tp + fp + pos), 6) AS f1, round((tp + neg - fp) / (pos + neg), 6) AS accuracy, round(auc::DOUBLE, 6) AS auc FROM c, u""",
)
def gate_auc_f1(spark, sf):
    g = M.gate_metrics(_scored(spark, sf), "label", "score", 0.59)
    return g.select(*(F.round(c, 6).alias(c) for c in g.columns))


@query("best_f1_threshold", f"WITH {_SCORED_SQL}, t AS (SELECT DISTINCT score FROM scored), f AS (SELECT t.score AS threshold, sum((label = 1 AND s.score >= t.score)::INT) AS tp, sum((s.score >= t.score)::INT) AS kept, sum((label = 1)::INT) AS pos FROM t, scored s GROUP BY 1) SELECT threshold, round(2.0::DOUBLE * tp / (kept + pos), 6) AS f1 FROM f ORDER BY 2.0::DOUBLE * tp / (kept + pos) DESC, threshold DESC LIMIT 1")
def best_f1_threshold(spark, sf):
    return M.best_f1(_scored(spark, sf), "label", "score").select("threshold", F.round("f1", 6).alias("f1"))


_RUNS_SQL = "runs AS (SELECT ts::DATE AS day, round(avg(value), 6) AS v FROM events GROUP BY 1)"


@query(
    "zscore_drift",
    f"""WITH {_RUNS_SQL}, s AS (SELECT day, v, count(v) OVER w AS c, avg(v) OVER w AS m, stddev_samp(v) OVER w AS sd FROM runs WINDOW w AS (ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
    z AS (SELECT day, CASE WHEN c < 2 THEN NULL WHEN sd < 1e-9 THEN 0 ELSE (v - m) / sd END AS z FROM s) SELECT day::VARCHAR AS day, round(z, 6) AS z, coalesce(z < -2, FALSE) AS drift, coalesce(z < -2, FALSE) AND coalesce(lag(coalesce(z < -2, FALSE)) OVER (ORDER BY day), FALSE) AS rollback FROM z""",
)
def zscore_drift(spark, sf):
    runs = read_table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))
    return M.zscores(runs, "day", "v").select(F.col("day").cast("string").alias("day"), F.round("z", 6).alias("z"), "drift", "rollback")


@query("centroid_drift", f"WITH {VECTORS_SQL}, p AS (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM vectors), m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY 1) SELECT a.label, round(1 - list_cosine_similarity(a.c, b.c), 6) AS drift FROM c a JOIN c b ON b.label = 0")
def centroid_drift(spark, sf):
    c = M.centroids(T.vectors(spark, sf), "label", 64)
    first = c.where("label = 0").select(F.col("centroid").alias("snapshot"))
    return c.crossJoin(first).select("label", F.round(1 - S.cosine(F.col("centroid"), F.col("snapshot")), 6).alias("drift"))


@query("pair_dataset", None)
def pair_dataset(spark, sf):
    return M.pair_dataset(T.vectors(spark, sf).select(F.col("vec_id").alias("id"), F.col("label").alias("topic"))).groupBy("label").agg(F.count("*").alias("pairs"))


@query("sft_pairs", "WITH t AS (SELECT conv_id, turn, role, text AS prompt, lead(role) OVER w AS r, lead(text) OVER w AS response FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, prompt, response FROM t WHERE role = 'user' AND r = 'assistant' AND length(prompt) >= 20 AND length(response) >= 20 AND prompt <> response")
def sft_pairs(spark, sf):
    return D.sft_pairs(read_table(spark, sf, "conversations"))


@query("critic_decisions", f"WITH {_KNN_SQL}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM s) WHERE place <= 5) SELECT query, round(max(score), 6) AS top, round(avg(score), 6) AS mean, max(score) >= 0.5 AND avg(score) >= 0.45 AS accept FROM h GROUP BY 1")
def critic_decisions(spark, sf):
    hits = R.knn(_vector_queries(spark, sf), _base(spark, sf), 5, places=6)
    lists = hits.groupBy("query").agg(S.critic_features(F.array_sort(F.collect_list("score")), F.lit("")).alias("f"))
    return lists.select("query", F.round(F.col("f")[0], 6).alias("top"), F.round(F.col("f")[1], 6).alias("mean"), S.critic_accepts(F.col("f")).alias("accept"))


@query("boundary_samples", "WITH s AS (SELECT doc_id, n_chars % 997 / 997::DOUBLE AS p FROM documents) SELECT doc_id, round(abs(p - 0.5), 6) AS margin FROM s WHERE abs(p - 0.5) <= 0.1 ORDER BY abs(p - 0.5), doc_id LIMIT 50")
def boundary_samples(spark, sf):
    margin = F.abs((F.col("n_chars") % 997) / F.lit(997.0) - 0.5)
    return read_table(spark, sf, "documents").where(margin <= 0.1).orderBy(margin, "doc_id").limit(50).select("doc_id", F.round(margin, 6).alias("margin"))


@query("label_correlation", f"WITH {_SCORED_SQL}, r AS (SELECT rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2 AS a, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS b FROM scored) SELECT round(corr(a, b), 6) AS rho FROM r")
def label_correlation(spark, sf):
    return M.spearman(_scored(spark, sf), "label", "score").select(F.round("rho", 6).alias("rho"))
