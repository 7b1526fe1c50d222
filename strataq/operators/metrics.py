"""Rank quality, classifier metrics, drift and dataset builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from strataq.storage import materialize

LOG2 = lambda c: F.log2(c.cast("double") + 1)


#: Ranges that a running sum without keys is cut into; their bounds and sums are all that is ordered in one place.
RANGES = 64


def running(rows: DataFrame, order: str, values: list[str], ranges: int | None = None) -> DataFrame:
    """Adds ``sum_<value>`` over all rows with an ``order`` below a row's; ``order`` is a number and differs from row to row.

    Rows are dealt to ranges of the order by approximate quantiles, summed up within, and ranges by
    themselves: no task gets all rows.
    """
    at = [k / (ranges or RANGES) for k in range(1, ranges or RANGES)]
    points = rows.agg(F.percentile_approx(order, at, 1000)).first()[0] if at else None
    bounds = F.array(*(F.lit(float(x)) for x in sorted(set(points)))) if points else F.array().cast("array<double>")
    cut = rows.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.col(order))))
    sums = cut.groupBy("_range").agg(*(F.sum(v).alias(f"_s_{v}") for v in values))
    # At most RANGES rows.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(sums.select("_range", *(F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values)))
    own = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.select("*", *(F.coalesce(F.sum(v).over(own), F.lit(0)).alias(f"_o_{v}") for v in values)).join(starts, "_range")
    return out.select(*rows.columns, *((F.col(f"_o_{v}") + F.col(f"_b_{v}")).alias(f"sum_{v}") for v in values))


def rank_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query, recall, mrr, ndcg) at ``k`` of (query, id, place) against (query, id).

    Queries without relevant items have none to find and are left out; without a hit all three are 0.
    """
    return _rank_metrics(relevant.groupBy("query").agg(F.count("*").alias("n")), ranked.join(relevant, ["query", "id"]), k)


def rank_metrics_by_label(ranked: DataFrame, queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """As ``rank_metrics``, where all of ``base`` (id, label) of a query's label are relevant to (query, label), itself left out."""
    held = base.groupBy("label").agg(F.count("*").alias("held"))
    own = base.withColumnRenamed("id", "query").groupBy("query", "label").agg(F.count("*").alias("own"))
    size = queries.join(held, "label").join(own, ["query", "label"], "left").select("query", (F.col("held") - F.coalesce("own", F.lit(0))).alias("n")).where("n > 0")
    return _rank_metrics(size, ranked.where("query <> id").join(base, "id").join(queries, ["query", "label"]), k)


def _rank_metrics(size: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Of (query, n), the number of relevant items, and the ranked ones that are relevant (query, place)."""
    hit = found.where(F.col("place") <= k).groupBy("query").agg(F.count("*").alias("hits"), F.sum(1 / LOG2(F.col("place"))).alias("dcg"))
    first = found.groupBy("query").agg(F.min("place").alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / LOG2(i))
    all_ = size.join(hit, "query", "left").join(first, "query", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return all_.select("query", zero(F.col("hits") / F.col("n")).alias("recall"), zero(1.0 / F.col("first")).alias("mrr"), zero(F.col("dcg") / ideal).alias("ndcg"))


def mean_metrics(scores: DataFrame, *keys: str) -> DataFrame:
    m = lambda c: F.round(F.avg(c), 4).alias(c)
    return scores.groupBy(*keys).agg(m("recall"), m("mrr"), m("ndcg"), F.count("*").alias("n"))


def flip_gate(baseline: DataFrame, candidate: DataFrame, gain: float = 0.02, drop: float = 0.01) -> DataFrame:
    """One row: the relative gain of ndcg, whether recall or mrr fell by more than ``drop``, and the decision."""
    side = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in ("recall", "mrr", "ndcg")))
    both = side(baseline, "b").crossJoin(side(candidate, "c"))
    rel = F.when(F.col("b_ndcg") > 0, (F.col("c_ndcg") - F.col("b_ndcg")) / F.col("b_ndcg")).when(F.col("c_ndcg") == 0, 0.0).otherwise(1.0)
    worse = (F.col("c_recall") - F.col("b_recall") < -drop) | (F.col("c_mrr") - F.col("b_mrr") < -drop)
    return both.select(F.round(rel, 4).alias("relative_gain"), worse.alias("regressed"), ((rel >= gain) & ~worse).alias("flip"))


def gate_metrics(scored: DataFrame, label: str, score: str, threshold: float, *keys: str) -> DataFrame:
    """recall, bleed_rejection, precision, f1, accuracy and auc of keeping scores at or above ``threshold``.

    The area is the rank sum with ties counted half. Ranks come from a running count over distinct scores,
    which are aggregated first.
    """
    per = scored.groupBy(*keys, score).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("n"))
    if keys:
        below = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
        per = per.withColumn("sum_n", F.coalesce(F.sum("n").over(below), F.lit(0)))
    else:
        per = running(per, score, ["n"])
    per = per.withColumn("area", F.col("p") * (F.col("sum_n") + F.col("n") / 2))
    keep = F.col(score) >= threshold
    some = lambda c, w: F.sum(F.when(w, F.col(c)).otherwise(0))
    agg = per.groupBy(*keys).agg(some("p", keep).alias("tp"), some("n", keep).alias("fp"), F.sum("p").alias("pos"), F.sum("n").alias("neg"), F.sum("area").alias("area"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    recall, precision = ratio(F.col("tp"), F.col("pos")), ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    f1 = ratio(2 * precision * recall, precision + recall)
    return agg.select(
        *keys, recall.alias("recall"), ratio(F.col("neg") - F.col("fp"), F.col("neg")).alias("bleed_rejection"), precision.alias("precision"), f1.alias("f1"),
        ratio(F.col("tp") + F.col("neg") - F.col("fp"), F.col("pos") + F.col("neg")).alias("accuracy"), F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("area") / (F.col("pos") * F.col("neg"))).alias("auc"),
    )


def best_f1(scored: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, f1): the score at which keeping it and all above has the best F1; the highest such score."""
    per = scored.groupBy(score).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.count("*").alias("c"))
    total = F.broadcast(per.agg(F.sum("p").alias("pos"), F.sum("c").alias("all")))
    run = running(per, score, ["p", "c"]).crossJoin(total)
    run = run.select(F.col(score).alias("threshold"), (F.col("pos") - F.col("sum_p")).alias("tp"), (F.col("all") - F.col("sum_c")).alias("kept"), "pos")
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("kept") + F.col("pos"))).otherwise(0.0)
    best = run.withColumn("f1", f1).agg(F.max(F.struct("f1", "threshold")).alias("b"))
    return best.select("b.threshold", "b.f1")


def zscores(runs: DataFrame, order: str, value: str, window: int = 10, limit: float = -2.0, ranges: int = RANGES) -> DataFrame:
    """Adds ``z`` against the ``window`` runs before (null with fewer than two, 0 without spread), ``drift``
    below ``limit``, and ``rollback`` when this run and the one before both drift.

    Runs are numbered in their ``order``, a number or date that differs from run to run, and dealt to about ``ranges`` stretches of equal
    length; each gets the last runs before it as well, so no task holds all.
    """
    at = F.col(order) if isinstance(runs.schema[order].dataType, NumericType) else F.unix_micros(F.col(order).cast("timestamp"))
    numbered = running(runs.withColumns({"_at": at.cast("double"), "_one": F.lit(1).cast("long")}), "_at", ["_one"], ranges)
    numbered = materialize(numbered.select(*runs.columns, F.col("sum__one").cast("long").alias("_n")), "runs")
    length = F.lit(max(1, -(-numbered.count() // ranges))).cast("long")
    first = F.floor(F.col("_n") / length)
    # One run more than the window: the run before the first of a stretch has a drift of its own.
    dealt = numbered.withColumn("_stretch", F.explode(F.sequence(first, F.floor((F.col("_n") + window + 1) / length)))).withColumn("_own", F.col("_stretch") == first)
    of = Window.partitionBy("_stretch").orderBy("_n")
    before = of.rowsBetween(-window, -1)
    sd = F.stddev_samp(value).over(before)
    z = F.when(F.count(value).over(before) < 2, None).when(sd < 1e-9, 0.0).otherwise((F.col(value) - F.avg(value).over(before)) / sd)
    out = dealt.withColumn("z", z).withColumn("drift", F.coalesce(F.col("z") < limit, F.lit(False)))
    out = out.withColumn("rollback", F.col("drift") & F.coalesce(F.lag("drift").over(of), F.lit(False)))
    return out.where("_own").select(*runs.columns, "z", "drift", "rollback")


def proxy_relevance(items: DataFrame) -> DataFrame:
    """(group, size): items of a group with another item are relevant to each other; groups of one drop out."""
    return items.where("group IS NOT NULL").groupBy("group").agg(F.count("*").alias("size")).where("size > 1")


def sampled(rows: DataFrame, key: str, n: int, salt: str = "sample") -> DataFrame:
    """A reproducible sample of ``n`` rows, by hash of the key."""
    return rows.orderBy(F.xxhash64(F.lit(salt), key), key).limit(n)


def pair_dataset(items: DataFrame, n_negatives: int = 2) -> DataFrame:
    """(a, b, label) of items (id, topic): all pairs of a topic as positives, and
    about ``n_negatives`` an item of different topics: items meet on hashed slots, one item a slot on
    average, so that negatives are never formed by pairing everything."""
    ids = items.select("id", "topic")
    other = ids.select(F.col("id").alias("b"), F.col("topic").alias("b_topic"))
    positive = ids.join(other, F.col("topic") == F.col("b_topic")).where("id < b").select(F.col("id").alias("a"), "b", F.lit(1).alias("label"))
    count = items.count()
    slots = F.lit(max(count, 1))
    partner = ids.select(F.pmod(F.xxhash64(F.lit("slot"), "id"), slots).alias("to"), F.col("id").alias("b"), F.col("topic").alias("b_topic"))
    met = ids.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n_negatives)))).withColumn("to", F.pmod(F.xxhash64("id", "k"), slots))
    negative = met.join(partner, "to").where("topic <> b_topic AND id <> b").select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"), F.lit(0).alias("label")).distinct()
    return positive.unionByName(negative)


def centroids(vectors: DataFrame, key: str, size: int) -> DataFrame:
    """(key, centroid): mean vectors at length 1; sums per place are aggregated before the shuffle."""
    from strataq.functions.scoring import unit

    means = [F.avg(F.col("vec")[i]) for i in range(size)]
    return vectors.groupBy(key).agg(unit(F.array(*means)).alias("centroid"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rank correlation of two numbers with mean ranks for ties. Ranks are taken of distinct values, then joined to the rows."""

    def ranked(df: DataFrame, c: str) -> DataFrame:
        ranks = running(rows.groupBy(c).agg(F.count("*").alias("n")), c, ["n"]).select(F.col(c).alias("_v"), (F.col("sum_n") + (F.col("n") + 1) / 2).alias(f"_{c}"))
        return df.join(ranks, F.col(c) == F.col("_v")).drop("_v")

    return ranked(ranked(rows, a), b).agg(F.corr(f"_{a}", f"_{b}").alias("rho"))


def keyword_ratio(text: Column, words: tuple[str, ...]) -> Column:
    """Share of keywords that a text contains, without case."""
    return sum((F.contains(F.lower(text), F.lit(w.lower())).cast("double") for w in words), F.lit(0.0)) / max(1, len(words))
