"""Ranking, running-length and tail operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per key; Spark limits groups on both sides of the shuffle."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= k).drop("_place")


def replay_tail(log: DataFrame, ts: str, tie: str, start: str, end: str, limit: int, where: Column | None = None) -> DataFrame:
    """The last ``limit`` entries of a time range, in their order."""
    rows = log.where((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")))
    rows = rows.where(where) if where is not None else rows
    return rows.orderBy(F.desc(ts), F.desc(tie)).limit(limit).orderBy(ts, tie)


def session_text(turns: DataFrame, limit: int, newest_first: bool, least: int = 20) -> DataFrame:
    """(conv_id, body): lines ``ROLE: text`` of a session while their running length is within ``limit``,
    counted from its oldest or newest turn, in the order of turns."""
    line = F.concat(F.upper("role"), F.lit(": "), F.col("text"))
    order = F.desc("turn") if newest_first else F.asc("turn")
    run = F.sum(F.length("line")).over(Window.partitionBy("conv_id").orderBy(order))
    kept = turns.where(F.length("text") > least).select("conv_id", "turn", line.alias("line")).withColumn("run", run).where(F.col("run") <= limit)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy("conv_id").agg(body.alias("body"))


def first_across_tiers(tiers: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, tier): every id with the first tier that has it; tiers in the order given."""
    named = [df.select(key, F.lit(i).alias("_rank"), F.lit(name).alias("tier")) for i, (name, df) in enumerate(tiers.items())]
    return reduce(DataFrame.unionByName, named).groupBy(key).agg(F.min_by("tier", "_rank").alias("tier"))


def budget_cut(rows: DataFrame, keys: list[str], place: str, length: Column, budget: int) -> DataFrame:
    """Rows in their place while the running length is within ``budget``; the first is always kept and
    nothing after the first overflow is. Adds ``total_chars`` and ``truncated``."""
    w = Window.partitionBy(*keys).orderBy(place)
    run = rows.withColumn("total_chars", F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    over = (F.col("total_chars") > budget) & (F.col(place) > 1)
    run = run.withColumn("_over", F.max(over.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("truncated", F.max(over).over(Window.partitionBy(*keys)))
    return run.where("_over = 0").drop("_over")


def greedy_mmr(rows: DataFrame, keys: list[str], item: str, score: str, words: str, k: int, trade: float = 0.75) -> DataFrame:
    """Maximal marginal relevance: ``k`` rounds, each adding per key the item with the best
    trade * score - (1 - trade) * its largest word overlap with those chosen. Ties go to the smaller item.
    Adds ``place``. ``k`` is small; the rounds are unrolled, one aggregation and join each."""
    from strataq.functions.scoring import overlap_max
    from strataq.storage import materialize

    # The similarity so far rides along; each round only compares with the item chosen last.
    left = rows.withColumn("_sim", F.lit(0.0))
    chosen: DataFrame | None = None
    for place in range(1, k + 1):
        value = F.col(score) if place == 1 else trade * F.col(score) - (1 - trade) * F.col("_sim")
        best = left.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(value, (-F.col(item)).alias("_tie"))).alias("_b"))
        picked = materialize(best.select("_b.*", F.lit(place).alias("place")), "mmr")
        chosen = picked if chosen is None else chosen.unionByName(picked)
        last = picked.select(*keys, F.col(item).alias("_item"), F.col(words).alias("_words"))
        left = left.join(last, keys).where(F.col(item) != F.col("_item"))
        left = left.withColumn("_sim", F.greatest("_sim", overlap_max(F.col(words), F.col("_words")))).drop("_item", "_words")
    return chosen
