"""Sweeps in an order, settled in bulk rounds instead of one item after another.

An item is kept unless an earlier kept item rules it out. A round settles each item of whose earlier ones one is
kept, or all are settled. Of the items left, those that wait for a single other one form chains: such an item is
kept if that one is not, so chains are run through by pointer doubling, however long they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.storage import discard, kept, materialize, scratch


def kept_in_order(items: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, kept) of the items (id): one is kept unless a kept one rules it out, by ``rules`` (early, late) among them.

    Rules have to lead from an earlier item to a later one, else some may wait for each other, which raises. Rules are summed up
    per item before they are shuffled, those of settled items are left out, and rounds are written to the shared folder.
    """
    with scratch() as made:
        edges = materialize(rules.select("early", "late").distinct(), "order-rules")
        ruled = edges.select(F.col("late").alias("id")).distinct()
        fresh = settled = materialize(items.select("id").distinct().join(ruled, "id", "left_anti").withColumn("kept", F.lit(True)), "order-settled")
        while edges.limit(1).count():
            # Those settled last decide: a kept item rules the later one out, another frees it.
            met = edges.join(fresh.select(F.col("id").alias("early"), "kept"), "early", "left")
            waits = F.col("kept").isNull()
            of = met.groupBy("late").agg(F.coalesce(F.max("kept"), F.lit(False)).alias("ruled"), F.sum(waits.cast("long")).alias("waits"), F.max(F.when(waits, F.col("early"))).alias("one"))
            of = materialize(of, "order-states")
            now = of.where("ruled OR waits = 0").select(F.col("late").alias("id"), (~F.col("ruled")).alias("kept"))
            chains = materialize(of.where("NOT ruled AND waits = 1").select(F.col("late").alias("id"), F.col("one").alias("to"), F.lit(True).alias("odd")), "order-chains")
            fresh, before = materialize(now.unionByName(_through(chains, now)), "order-now"), fresh
            if not fresh.limit(1).count():
                raise RuntimeError("items wait for each other: rules do not lead from earlier to later ones")
            left = met.where("kept IS NULL").select("early", "late").join(fresh.select(F.col("id").alias("late")), "late", "left_anti")
            gone = (edges, of, before, settled)
            edges, settled = materialize(left, "order-rules"), materialize(settled.unionByName(fresh), "order-settled")
            for df in gone:
                discard(df)
        return kept(made, settled)


def _through(chains: DataFrame, settled: DataFrame) -> DataFrame:
    """(id, kept) of those items of ``chains`` (id, to, odd), each kept if ``to`` is not, whose chain ends in a settled item."""
    for _ in range(chains.count().bit_length() + 1):
        step = chains.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("odd").alias("_odd"))
        if not chains.join(step, "to", "left_semi").limit(1).count():
            return chains.join(settled.select(F.col("id").alias("to"), F.col("kept").alias("_kept")), "to").select("id", (F.col("_kept") != F.col("odd")).alias("kept"))
        on = F.col("_to").isNotNull()
        new = chains.join(step, "to", "left").select("id", F.coalesce("_to", "to").alias("to"), F.when(on, F.col("odd") != F.col("_odd")).otherwise(F.col("odd")).alias("odd"))
        before, chains = chains, materialize(new, "order-chains")
        discard(before)
    raise RuntimeError("items wait for each other: rules do not lead from earlier to later ones")
