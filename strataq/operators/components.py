"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.storage import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Return (node, component) for every node of ``edges``; the component is its smallest node.

    Edges have no direction; nulls, loops and repeated edges are ignored. Every round is
    written to the shared folder. Per-node minima are aggregated before they are shuffled
    and joined from a written table, so a hub's edges can be split over tasks. Rounds end when
    only stars around smallest nodes are left.
    """
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    e = materialize(e.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")).distinct(), "cc-edges")
    for _ in range(max_rounds):
        if _only_stars(e):
            break
        # A node's smallest neighbour, itself included, takes over the node's larger neighbours.
        both = e.select(F.col("lo").alias("u"), F.lit(None).cast(e.schema["lo"].dataType).alias("v")).union(e.select("hi", "lo"))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.coalesce("m", "u").alias("m")), "cc-least")
        large = materialize(e.join(least, e.lo == least.u).select("hi", F.col("m").alias("lo")), "cc-large")
        # Then every node's smaller neighbours are tied to the smallest of them.
        low = materialize(large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")), "cc-low")
        tied = large.join(low, large.hi == low.u).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        small = materialize(tied.union(low.select("u", "m")).distinct(), "cc-small")
        for done in (e, least, large, low):
            discard(done)
        e = small
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select("lo", "lo").distinct())


def _only_stars(e: DataFrame) -> bool:
    """Whether every larger end has one edge and is no smaller end. Rounds keep what is connected, so such edges are final."""
    ends = e.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("lo", F.lit(0), F.lit(1)))
    roles = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.where("up > 1 OR (up = 1 AND down = 1)").limit(1).count() == 0
