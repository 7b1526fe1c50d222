"""Mixing sources to target weights by Pfair scheduling; DataFrame operations alone.

A source's documents, in an order shuffled by hash, are cut into blocks of equal size. Block i of a
source with share w is released at slot floor(i / w) and due at slot ceil((i + 1) / w); each slot
takes the released block that is due first. Every prefix of the mix then holds each source to less
than one block of its share. When a source runs out, the others go on in a new phase with their
shares scaled up. The schedule of a phase repeats, so the driver plans it from the weights and one
count per source; which document begins in which block is found by prefix sums over the tables. The
plan is a table of the phases of each source and one of their slots, joined by Spark's own size check.
Texts of any length count by their length alone and are not moved.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataq.llm.textstats import packed, unpacked
from strataq.storage import kept, materialize, read_table, scratch

MAX_SOURCES = 2000
MAX_PERIOD = 100_000
#: Slots of all phases' periods together, which the driver plans and holds: 8 bytes each when sent, some 40 while planned.
MAX_SLOTS = 5_000_000
#: Buckets of a source whose sizes are summed up together, before these sums are.
GROUP = 4096


def edf_period(parts: list[int], left: list[int] | None = None) -> list[int]:
    """The source of each of sum(parts) slots: of released blocks the one due first, ties to the first source.

    Ends with the slot in which a source with no more than ``left`` blocks runs out.
    """
    period = sum(parts)
    done, out = [0] * len(parts), []
    waiting = [(0, s) for s, p in enumerate(parts) if p]
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[s] + 1) * period // parts[s]), s))
        s = heapq.heappop(ready)[1]
        out.append(s)
        done[s] += 1
        if left and done[s] == left[s]:
            break
        if done[s] < parts[s]:
            heapq.heappush(waiting, (done[s] * period // parts[s], s))
    return out


def plan_phases(parts: list[int], blocks: list[int]) -> list[list[dict]]:
    """Per source the phases in which it has blocks: first block, part of the period, period, first slot and slots within the period.

    A phase's parts are divided by what is common to them, which leaves its schedule as it is. More than MAX_SLOTS slots raise.
    """
    planned = 0
    left, taken, start = list(blocks), [0] * len(parts), 0
    out: list[list[dict]] = [[] for _ in parts]
    while any(left):
        live = [p if n else 0 for p, n in zip(parts, left)]
        common = math.gcd(*live)
        live = [p // common for p in live]
        period, order = sum(live), edf_period(live, left)
        planned += len(order)
        if planned > MAX_SLOTS:
            raise ValueError(f"the phases have more than {MAX_SLOTS} slots in all: take smaller weights or group sources")
        slots: list[list[int]] = [[] for _ in parts]
        for t, s in enumerate(order):
            slots[s].append(t)
        if len(order) < period:
            end = len(order) - 1
        else:
            end = min((n - 1) // p * period + slots[s][(n - 1) % p] for s, (n, p) in enumerate(zip(left, live)) if p)
        for s, p in enumerate(live):
            used = end // period * p + sum(x <= end % period for x in slots[s])
            if used:
                out[s].append({"first": taken[s], "part": p, "period": period, "start": start, "slots": slots[s]})
                left[s] -= used
                taken[s] += used
        start += end + 1
    return out


def mix(docs: DataFrame, weights: dict[str, int], default_weight: int = 1, block_chars: int = 262_144, bucket_rows: int = 4096) -> DataFrame:
    """doc_id, source, block, block_offset, slot, release, deadline: a row per row of ``docs`` (doc_id, text, source).

    The mix is read in the order of slot, block_offset, doc_id. Weights are whole numbers; sources
    without one get ``default_weight``. A document counts its characters and one more, and belongs
    to the block in which it begins; a block may be passed over by a longer document. A null source
    is the source '', a null text is empty, rows that repeat are placed side by side, a null id
    comes first within its bucket; other columns are ignored and an empty table gives no rows.
    """
    spark = docs.sparkSession
    size = F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), size.alias("size"))
    rows = materialize(rows.withColumn("key", F.xxhash64(F.lit("mix"), "doc_id")), "mix-rows")
    totals = {r[0]: (r[1], r[2]) for r in rows.groupBy("source").agg(F.count("*"), F.sum("size")).limit(MAX_SOURCES + 1).collect()}
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    names = sorted(totals)
    parts = [int(weights.get(s, default_weight)) for s in names]
    if any(p < 1 for p in parts) or sum(parts) > MAX_PERIOD:
        raise ValueError(f"weights have to be 1 or more and {MAX_PERIOD} or less in all")
    phases = plan_phases(parts, [-(-totals[s][1] // block_chars) for s in names])
    table = lambda rows, schema: materialize(spark.createDataFrame(rows, schema), "mix-plan")
    # A row per source, at most MAX_SOURCES: the bound for this broadcast.
    buckets = F.broadcast(spark.createDataFrame([(s, -(-totals[s][0] // bucket_rows)) for s in names], "source string, buckets bigint"))
    rows = rows.join(buckets, "source").withColumn("bucket", F.pmod("key", "buckets")).drop("buckets")
    per_bucket = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "mix-bucket-sizes").withColumn("grp", F.expr(f"bucket div {GROUP}"))
    ahead = lambda order, *keys: F.coalesce(F.sum("size").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_groups = per_bucket.groupBy("source", "grp").agg(F.sum("size").alias("size")).select("source", "grp", ahead(["grp"], "source").alias("group_base"))
    of_buckets = per_bucket.select("source", "grp", "bucket", ahead(["bucket"], "source", "grp").alias("base")).join(of_groups, ["source", "grp"])
    starts = materialize(of_buckets.select("source", "bucket", (F.col("base") + F.col("group_base")).alias("base")), "mix-buckets")
    placed = rows.withColumn("at", ahead(["key", "doc_id"], "source", "bucket")).join(starts, ["source", "bucket"])
    placed = placed.withColumn("at", F.col("at") + F.col("base"))
    placed = placed.select("doc_id", "source", F.expr(f"at div {block_chars}").alias("block"), F.expr(f"at % {block_chars}").alias("block_offset"))
    stages = table([(s, [(k, p["first"], p["part"], p["period"], p["start"]) for k, p in enumerate(ph)]) for s, ph in zip(names, phases)], f"source string, phases array<{PHASE}>")
    slots = spark.createDataFrame([(s, k, p["slots"]) for s, ph in zip(names, phases) for k, p in enumerate(ph)], "source string, k bigint, slots array<bigint>")
    slots = materialize(slots.select("source", "k", F.posexplode("slots").alias("nth", "within")), "mix-plan")
    placed = placed.join(stages, "source").withColumn("p", F.element_at(F.filter("phases", lambda x: x["first"] <= F.col("block")), -1))
    placed = placed.select("doc_id", "source", "block", "block_offset", "p", F.expr("block - p.first").alias("i"), F.col("p.k").alias("k"), F.expr("(block - p.first) % p.part").alias("nth"))
    return placed.join(slots, ["source", "k", "nth"]).select(
        "doc_id", "source", "block", "block_offset",
        F.expr("p.start + (i div p.part) * p.period + within").alias("slot"),
        F.expr("p.start + (i * p.period) div p.part").alias("release"),
        F.expr("p.start + ((i + 1) * p.period + p.part - 1) div p.part").alias("deadline"),
    )


#: A phase of a source: its number, first block, blocks and slots of a period, and first slot.
PHASE = "struct<k:bigint,first:bigint,part:bigint,period:bigint,start:bigint>"


#: Production weights: src0 gives three times as much as any other source.
WEIGHTS = {"src0": 3}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"), WEIGHTS)


def mixed_order(docs: DataFrame, weights: dict[str, int] = WEIGHTS, placed: bool = False) -> DataFrame:
    """All rows of ``docs`` with their columns, range-partitioned and sorted in the order of the mix.

    Rows with equal ids share the first of their places, and rows with a null id come last. With
    ``placed``, slot and block_offset are added, null for a null id; a column named like them gives
    way. Places depend on the set of rows alone, so rows in any order get the same ones.
    """
    with scratch() as made:
        order = mix(docs, weights).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("slot", "block_offset")).alias("_place"))
        order = kept(made, materialize(order.withColumnRenamed("doc_id", "_mixed"), "mix-order"))
    rows = docs.select(packed(docs), F.col("doc_id").cast("long").alias("_id"))
    rows = rows.join(order, F.col("_id") == F.col("_mixed"), "left").orderBy(F.col("_place").asc_nulls_last(), "_id")
    names = ("slot", "block_offset") if placed else ()
    return unpacked(rows, *(F.col("_place")[n].alias(n) for n in names), names=names)
