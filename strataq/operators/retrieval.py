"""Lexical, dense, sparse and hybrid top-k retrieval, fusion, gates and context assembly."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataq.functions import scoring as S
from strataq.operators.nearest import near_pairs
from strataq.operators.windows import budget_cut, top_per_key
from strataq.storage import materialize

K1, B, AVERAGE = 1.2, 0.75, 200.0
RRF = 60


def lexical_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query, id, score) from (query, tokens) and (id, tokens): share of the query's tokens in the text.

    Documents are filtered to the queries' tokens as they are exploded; matches are counted per pair.
    """
    q = queries.select("query", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    d = docs.select("id", F.explode("tokens").alias("token"))
    hits = d.join(q, "token").groupBy("query", "n", "id").agg(F.count("*").alias("common"))
    return hits.select("query", "id", (F.col("common") / F.col("n")).alias("score"))


def top_k(scores: DataFrame, k: int, tie: str = "id") -> DataFrame:
    """The best ``k`` per query with their ``place``; ties by id."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), tie))
    return scores.withColumn("place", place).where(F.col("place") <= k)


def assemble_context(hits: DataFrame, text: Column, title: Column, budget: int = 6000) -> DataFrame:
    """Blocks ``[SOURCE n]`` of ranked hits (query, place, score, ...) within ``budget`` characters."""
    meta = F.concat(F.lit("[SOURCE "), F.col("place").cast("string"), F.lit("]\nTitle: "), title, F.lit("\n"), text, F.lit("\n---\n"))
    return budget_cut(hits.withColumn("block", meta), ["query"], "place", F.length("block"), budget)


def query_postings(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(token, id, length, tf) of the tokens of (query, tokens) in (id, words), words with repeats: a written table, so that texts are cut once."""
    asked = queries.select(F.explode("tokens").alias("token")).distinct()
    sized = docs.select("id", F.size("words").alias("length"), F.explode("words").alias("token"))
    return materialize(sized.join(asked, "token", "left_semi").groupBy("token", "id", "length").agg(F.count("*").alias("tf")), "query-postings")


def bm25(queries: DataFrame, docs: DataFrame, k1: float = K1, b: float = B, average: float = AVERAGE) -> DataFrame:
    """(query, id, score) of (query, tokens) against (id, words), words with repeats; a fixed average
    length, inverse document frequency ln(1 + (N - df + .5) / (df + .5)).

    Postings are only built for the queries' tokens.
    """
    return bm25_of(queries, query_postings(queries, docs), docs, k1, b, average)


def bm25_of(queries: DataFrame, postings: DataFrame, docs: DataFrame, k1: float = K1, b: float = B, average: float = AVERAGE) -> DataFrame:
    """``bm25`` from the ``query_postings`` of its queries; ``docs`` (id) are counted."""
    q = queries.select("query", F.explode(F.array_distinct("tokens")).alias("token"))
    df = postings.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf").cast("double")
    part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / average))
    return postings.join(df, "token").join(q, "token").groupBy("query", "id").agg(F.sum(part).alias("score"))


def lexical_of(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """``lexical_scores`` of (query, tokens), distinct ones, from their ``query_postings``."""
    q = queries.select("query", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    hits = postings.select("token", "id").join(q, "token").groupBy("query", "n", "id").agg(F.count("*").alias("common"))
    return hits.select("query", "id", (F.col("common") / F.col("n")).alias("score"))


def vector_scores(queries: DataFrame, base: DataFrame, least: float | None = None, same: str | None = None, places: int | None = None) -> DataFrame:
    """(query, id, score): cosines of (query, vec) with all of (id, vec), itself left out, from ``least`` on.

    ``same``, a column of both, restricts pairs to those of equal values. Scores may be rounded to ``places``.
    """
    return near_pairs(queries, base, None, least, places, same)


def knn(queries: DataFrame, base: DataFrame, k: int, least: float | None = None, same: str | None = None, places: int | None = None) -> DataFrame:
    """(query, id, score, place): exact cosine nearest neighbours of (query, vec) among (id, vec), itself left out,
    by cosines rounded to ``places`` if given, ties by id.

    Blocks of vectors give ``k`` per query before the shuffle.
    """
    return top_k(near_pairs(queries, base, k, least, places, same), k)


def fan_out(queries: DataFrame, stores: dict[str, DataFrame], k: int, least: float = 0.59, same: str | None = None, places: int = 6) -> DataFrame:
    """(query, store, id, score, place): the best ``k`` over all stores of (id, vec, ...) for (query, vec, ...).

    Every store gives up to 2 * k hits from ``least`` on, by cosines rounded to ``places``; an id in several stores counts where it scores
    best, ties to the store's name. ``same``, a column of both, restricts pairs, as a filter on an agent does.
    """
    lanes = None
    for name, base in sorted(stores.items()):
        lane = knn(queries, base, 2 * k, least, same, places).select("query", F.lit(name).alias("store"), "id", "score")
        lanes = lane if lanes is None else lanes.unionByName(lane)
    place = F.row_number().over(Window.partitionBy("query", "id").orderBy(F.desc("score"), "store"))
    return top_k(lanes.withColumn("_n", place).where("_n = 1").drop("_n"), k).select("query", "store", "id", "score", "place")


def vector_cells(base: DataFrame, cells: int = 64) -> tuple[DataFrame, list[list[float]]]:
    """An index for approximate search: (id, u, cell) of every vector of (id, vec) at length 1, and the points that cells lie around.

    Points are ``cells`` vectors, taken by hash; every vector is in the cell of its nearest one. Stored
    partitioned by cell, a search reads only the cells that it probes.
    """
    v = base.select("id", S.unit(F.col("vec")).alias("u")).where(F.size("u") > 0)
    points = [list(r["u"]) for r in v.orderBy(F.xxhash64("id"), "id").limit(cells).collect()]
    return v.withColumn("cell", F.element_at(nearest_points(F.col("u"), points, 1), 1)) if points else v.withColumn("cell", F.lit(0)), points


def nearest_points(u: Column, points: list[list[float]], n: int) -> Column:
    """The numbers of the ``n`` nearest of some points to a vector."""
    fixed = F.array(*(F.array(*(F.lit(float(x)) for x in p)) for p in points))
    order = F.array_sort(F.transform(fixed, lambda p, i: F.struct((-S.dot(u, p)).alias("d"), i.alias("i"))))
    return F.transform(F.slice(order, 1, n), lambda x: x["i"])


def approximate_knn(queries: DataFrame, index: DataFrame, points: list[list[float]], k: int, probes: int) -> DataFrame:
    """(query, id, score, place): neighbours of (query, vec) within the ``probes`` cells nearest to it, itself left out."""
    q = queries.select("query", S.unit(F.col("vec")).alias("q")).where(F.size("q") > 0)
    asked = q.withColumn("cell", F.explode(nearest_points(F.col("q"), points, probes) if points else F.array(F.lit(0))))
    met = index.join(asked, "cell").where(F.col("query") != F.col("id"))
    return top_k(met.select("query", "id", S.dot(F.col("u"), F.col("q")).alias("score")), k)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall): the share of exact neighbours (query, id) that were found."""
    hit = exact.select("query", "id").join(found.select("query", "id", F.lit(1).alias("_hit")), ["query", "id"], "left")
    return hit.agg((F.count("_hit") / F.count("*")).alias("recall"))


def rrf(lists: list[DataFrame], k: int = RRF) -> DataFrame:
    """(query, id, score): sum of 1 / (k + place) over ranked lists (query, id, place)."""
    rows = lists[0].select("query", "id", "place")
    for more in lists[1:]:
        rows = rows.unionByName(more.select("query", "id", "place"))
    return rows.groupBy("query", "id").agg(F.sum(1.0 / (k + F.col("place"))).alias("score"))


def rerank(hits: DataFrame, scorer: Column, top: int) -> DataFrame:
    """The first ``top`` hits by ``scorer``, the others behind them in their order."""
    score = F.when(F.col("place") <= top, scorer)
    place = F.row_number().over(Window.partitionBy("query").orderBy(score.desc_nulls_last(), "place"))
    return hits.withColumn("place", place)


def entropy_weighted(hits: DataFrame, k: int) -> DataFrame:
    """(query, level, id, score, weight, weighted): per level the best ``k``, weighted by 1 / (1 + entropy of
    their softmax), normalised over a query's levels; a level with one hit weighs 1 before that."""
    best = top_per_key(hits, ["query", "level"], [F.desc("score"), F.asc("id")], k)
    level = Window.partitionBy("query", "level")
    p = best.withColumn("_e", F.exp(F.col("score") - F.max("score").over(level)))
    p = p.withColumn("_p", F.col("_e") / F.sum("_e").over(level)).withColumn("_n", F.count("*").over(level))
    p = p.withColumn("_w", F.when(F.col("_n") < 2, 1.0).otherwise(1 / (1 - F.sum(F.col("_p") * F.log("_p")).over(level))))
    total = F.sum(F.col("_w") / F.col("_n")).over(Window.partitionBy("query"))
    return p.withColumn("weight", F.col("_w") / total).withColumn("weighted", F.col("score") * F.col("weight")).select("query", "level", "id", "score", "weight", "weighted")


def metamemory_cues(hits: DataFrame) -> DataFrame:
    """Per query the five cues of its hits (score, place, source, confidence, occurrences) and the verdict on them."""
    trust = S.by_value(F.col("confidence"), S.TRUST, 0.5)
    cues = hits.groupBy("query").agg(
        F.max(F.when(F.col("place") == 1, F.col("score"))).alias("fluency"), F.avg(F.when(F.col("place") <= 4, F.col("score"))).alias("accessibility"),
        F.count_distinct("source").alias("source_div"), (F.log1p(F.max("occurrences").cast("double")) / math.log1p(20)).alias("corroboration"), F.avg(trust).alias("trust"),
    )
    confidence, basis, advice = S.confidence_verdict(F.col("fluency"), F.col("accessibility"), F.col("source_div"), F.col("corroboration"), F.col("trust"))
    return cues.select("*", confidence.alias("confidence"), basis.alias("basis"), advice.alias("recommendation"))


def gate(scores: DataFrame, threshold: float = 0.59, limit: int = 12) -> DataFrame:
    """(query, n, kept): how many scores a query has, and how many of its best ``limit`` are at or above the threshold.

    Counts are summed up before they are shuffled, and ``limit`` scores per query and partition are ranked.
    """
    n = scores.groupBy("query").agg(F.count("*").alias("n"))
    kept = top_k(scores.where(F.col("score") >= threshold), limit).groupBy("query").agg(F.count("*").alias("kept"))
    return n.join(kept, "query", "left").select("query", "n", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))


def vector_gate(queries: DataFrame, base: DataFrame, threshold: float = 0.59, limit: int = 12, places: int | None = None) -> DataFrame:
    """(query, n, kept) as ``gate`` gives them of all cosines of (query, vec) with (id, vec): how many scores there are is counted
    without them, and only the best ``limit`` at or above the threshold are taken from blocks."""
    ids = base.where("id IS NOT NULL").select("id")
    q = queries.where("query IS NOT NULL").groupBy("query").agg(F.count("*").alias("times"))
    own = ids.join(q.select(F.col("query").alias("id")), "id").groupBy(F.col("id").alias("query")).agg(F.count("*").alias("own"))
    n = q.join(own, "query", "left").crossJoin(ids.agg(F.count("*").alias("total")))
    n = n.select("query", (F.col("times") * (F.col("total") - F.coalesce("own", F.lit(0)))).alias("n")).where("n > 0")
    kept = knn(queries, base, limit, threshold, places=places).groupBy("query").agg(F.count("*").alias("kept"))
    return n.join(kept, "query", "left").select("query", "n", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))


def word_search(docs: DataFrame, words: tuple[str, ...], all_of: bool, score: float) -> DataFrame:
    """(id, score) of texts that hold all words as tokens, or the first as a substring."""
    has = F.lit(True)
    for w in words:
        has &= F.array_contains(F.split(F.lower("text"), "[^a-z0-9]+"), w)
    return docs.where(has if all_of else F.contains(F.lower("text"), F.lit(words[0]))).select("id", F.lit(score).alias("score"))


def clean_expansions(query: Column, expansions: Column, limit: int) -> Column:
    """The query and up to ``limit`` different expansions, trimmed, compared without case."""
    all_ = F.filter(F.transform(F.concat(F.array(query), F.coalesce(expansions, F.array().cast("array<string>"))), lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(all_, F.lower)
    return F.slice(F.filter(all_, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), 1, limit + 1)
