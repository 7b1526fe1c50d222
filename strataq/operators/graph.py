"""Property-graph operators over node and edge tables: closures, traversals, impact, resolution.

Fixpoints advance a frontier one hop at a time, write each round to the shared folder, and end when a
round adds nothing. Bounded walks are unrolled joins.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataq.operators.pairs import overlap_pairs
from strataq.storage import discard, materialize


def closure(seeds: DataFrame, edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(node, hop): all nodes that edges (src, dst) reach from ``seeds`` (node), within ``max_hops`` if given, with their least distance."""
    reached = materialize(seeds.select("node").distinct().withColumn("hop", F.lit(0)), "closure")
    frontier = reached
    for hop in itertools.count(1) if max_hops is None else range(1, max_hops + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        fresh = materialize(step.join(reached.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)), "closure-hop")
        if not fresh.limit(1).count():
            break
        frontier, before = fresh, reached
        reached = materialize(reached.unionByName(fresh), "closure")
        discard(before)
    return reached


def widest_closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): reached nodes with the best, over all paths, of the least level along a path.

    Edges are (src, dst, level); levels are few (UNPROVEN 0, PROBABLE 1, PROVEN 2), so a node improves seldom.
    """
    best = materialize(seeds.select("node", "level"), "widest")
    frontier = best
    while True:
        step = frontier.withColumnRenamed("level", "_l").join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.least("_l", "level").alias("level"))
        step = step.groupBy("node").agg(F.max("level").alias("level"))
        known = best.withColumnRenamed("level", "_old")
        better = materialize(step.join(known, "node", "left").where("_old IS NULL OR level > _old").select("node", "level"), "widest-hop")
        if not better.limit(1).count():
            break
        frontier = better
        best = materialize(best.unionByName(better).groupBy("node").agg(F.max("level").alias("level")), "widest")
    return best


def chain(found: DataFrame, depth: int = 5) -> DataFrame:
    """(id, root, length, confidence, grounded, cycle): each finding's walk to its first parents.

    At most ``depth`` steps; a walk that comes back to its start ends there. Confidence is the product of
    numeric confidences along it, to six places; grounded if the root is observed.
    """
    node = materialize(found.select("id", "derived_from", "numeric", "record_type"), "chain-nodes")
    walk = node.select("id", F.col("id").alias("root"), F.col("derived_from").alias("next"), F.col("numeric").alias("p"), F.col("record_type").alias("t"), F.lit(0).alias("length"), F.array("id").alias("seen"))
    step = node.select(F.col("id").alias("_id"), F.col("derived_from").alias("_next"), F.col("numeric").alias("_p"), F.col("record_type").alias("_t"))
    for _ in range(depth):
        joined = walk.join(step, (F.col("next") == F.col("_id")) & ~F.array_contains("seen", F.col("next")), "left")
        on = F.col("_id").isNotNull()
        walk = joined.select(
            "id", F.when(on, F.col("_id")).otherwise(F.col("root")).alias("root"), F.when(on, F.col("_next")).alias("next"),
            F.when(on, F.col("p") * F.coalesce("_p", F.lit(1.0))).otherwise(F.col("p")).alias("p"), F.when(on, F.col("_t")).otherwise(F.col("t")).alias("t"),
            (F.col("length") + on.cast("int")).alias("length"), F.when(on, F.array_append("seen", F.col("_id"))).otherwise(F.col("seen")).alias("seen"),
        )
    return walk.select("id", "root", "length", F.round("p", 6).alias("confidence"), (F.col("t") == "observed").alias("grounded"))


def derived(anchors: DataFrame, parents: DataFrame) -> DataFrame:
    """(node) of the anchors (node) and all that is derived from one, by ``parents`` (child, parent), over any number of steps.

    Where no child has two parents, every child jumps to its parent, then twice as far in each round, and ends at an anchor or
    a root: a chain takes as many rounds as its length has binary digits. A child that has come as far as there are children is
    in a circle without anchors. Else a frontier advances.
    """
    edges = materialize(parents.where("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent").distinct(), "parents")
    if edges.groupBy("child").count().where("count > 1").limit(1).count():
        return closure(anchors, edges.select(F.col("parent").alias("src"), F.col("child").alias("dst"))).select("node")
    own = materialize(anchors.select("node").distinct(), "derived-anchors")
    stop = own.select(F.col("node").alias("_anchor"))
    # ``to`` is as far as a child has come without meeting an anchor; those that met one, and those at a root, are done.
    walk = edges.join(own.withColumnRenamed("node", "child"), "child", "left_anti").join(stop, F.col("parent") == F.col("_anchor"), "left")
    walk = materialize(walk.select("child", F.col("parent").alias("to"), F.col("_anchor").isNotNull().alias("hit")), "derived-walk")
    for _ in range(edges.count().bit_length() + 1):
        open_ = walk.where("NOT hit").join(walk.select(F.col("child").alias("to")), "to", "left_semi")
        if not open_.limit(1).count():
            break
        step = walk.select(F.col("child").alias("to"), F.col("to").alias("_to"), F.col("hit").alias("_hit"))
        new = walk.join(step, "to", "left").select("child", F.when(F.col("hit") | F.col("_to").isNull(), F.col("to")).otherwise(F.col("_to")).alias("to"), (F.col("hit") | F.coalesce("_hit", F.lit(False))).alias("hit"))
        walk, before = materialize(new, "derived-walk"), walk
        discard(before)
    return own.unionByName(walk.where("hit").select(F.col("child").alias("node")))


def contamination(seeds: DataFrame, mentions: DataFrame, parents: DataFrame, neighbours: DataFrame | None = None, least_shared: int = 1) -> DataFrame:
    """(node, reason): seeds, given semantic neighbours, findings that share ``least_shared`` distinctive
    entities with a seed, and whatever is derived from any of these, over any number of steps."""
    seed = seeds.select("node").distinct()
    if least_shared == 1:
        shared = mentions.join(mentions.join(seed, "node", "left_semi").select("entity").distinct(), "entity", "left_semi").select("node").distinct()
    else:
        sets = materialize(mentions.groupBy(F.col("node").alias("id")).agg(F.collect_set("entity").alias("tokens")), "mention-sets")
        shared = overlap_pairs(sets, sets.join(seed.select(F.col("node").alias("id")), "id", "left_semi"), least_shared).select(F.col("l").alias("node")).distinct()
    anchors = seed.withColumn("reason", F.lit(0)).union(shared.withColumn("reason", F.lit(2)))
    if neighbours is not None:
        anchors = anchors.union(neighbours.select("node", F.lit(1)))
    anchors = materialize(anchors.groupBy("node").agg(F.min("reason").alias("reason")), "anchors")
    reached = derived(anchors, parents)
    names = F.array(*map(F.lit, ("seed", "semantic", "entity")))
    return reached.join(anchors, "node", "left").select("node", F.coalesce(F.get(names, F.col("reason")), F.lit("derived_from")).alias("reason"))


def neighbourhood(anchor: DataFrame, edges: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``hops`` of the anchors, edges taken in both directions, and the edges among them."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    nodes = closure(anchor, both, hops)
    inside = nodes.select("node")
    kept = edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return nodes, kept


def impact(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per symbol (symbol, findings, investigations, co_referenced): who refers to it, and how many other
    symbols the same findings refer to. References are (finding, symbol, investigation)."""
    own = references.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    counts = own.groupBy("symbol").agg(F.count_distinct("finding").alias("findings"), F.count_distinct("investigation").alias("investigations"))
    together = _together(references, symbols).distinct().groupBy("symbol").agg(F.count("*").alias("co_referenced"))
    return counts.join(together, "symbol", "left").withColumn("co_referenced", F.coalesce("co_referenced", F.lit(0)))


def co_referenced(references: DataFrame, symbols: DataFrame, k: int = 8) -> DataFrame:
    """(symbol, other, shared, place): the ``k`` symbols most often referred to by the same findings."""
    counted = _together(references, symbols).groupBy("symbol", "other").agg(F.count("*").alias("shared"))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("shared"), "other"))
    return counted.withColumn("place", place).where(F.col("place") <= k)


#: References that a task pairs on average.
PAIRED = 250_000


def _together(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, other), a row per finding that refers to both, dealt out by both. There are as many tasks
    as there are references for them, so that what one of them holds does not grow with the table."""
    own = materialize(references.select("finding", "symbol").distinct(), "references")
    n = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-own.count() // PAIRED))
    dealt = own.repartition(n, "finding")
    pairs = dealt.join(symbols.select("symbol").distinct(), "symbol", "left_semi").join(dealt.withColumnRenamed("symbol", "other").hint("merge"), "finding")
    return pairs.where("symbol <> other").select("symbol", "other").repartition(2 * n, "symbol", "other")


def boundary(edges: DataFrame, inside: Column, outside: Column) -> DataFrame:
    """(direction, n): edges that cross into or out of a subsystem."""
    crossing = F.when(inside & ~outside, "out").when(~inside & outside, "in")
    return edges.select(crossing.alias("direction")).where("direction IS NOT NULL").groupBy("direction").agg(F.count("*").alias("n"))


def dead(symbols: DataFrame, calls: DataFrame, references: DataFrame, exempt: Column) -> DataFrame:
    """Symbols that nothing calls or refers to, unless they are exempt."""
    used = calls.select(F.col("dst").alias("symbol")).union(references.select("symbol")).distinct()
    return symbols.where(~exempt).join(used, "symbol", "left_anti")


def spread(seeds: DataFrame, edges: DataFrame, hops: int = 2, floor: float = 0.4, threshold: float = 0.5, fan: bool = True) -> DataFrame:
    """(node, activation) of nodes that are not seeds and reach ``threshold``.

    Synchronous hops: a frontier node gives each target its activation times the edge's weight, rescaled above
    the floor and boosted by the edge's kind, divided by its number of edges; activations add up to 1 at most.
    """
    boost = F.when(F.col("kind") == "caused_by", 1.3).when(F.col("kind") == "updated_by", 1.2).when(F.col("kind") == "contradicts", 0.0).otherwise(1.0)
    usable = edges.where((F.col("weight") >= floor) & (F.col("kind") != "contradicts"))
    usable = materialize(usable.select("src", "dst", F.least(F.lit(1.0), (F.col("weight") - floor) / (1 - floor) * boost).alias("w")), "spread-edges")
    degree = usable.groupBy("src").agg(F.count("*").alias("degree"))
    seed = materialize(seeds.select("node", "activation"), "spread-seeds")
    active, frontier = seed, seed.select("node")
    for _ in range(hops):
        sent = usable.join(frontier.withColumnRenamed("node", "src"), "src", "left_semi").join(active.withColumnRenamed("node", "src"), "src").join(degree, "src")
        share = F.col("activation") * F.col("w") / (F.col("degree") if fan else F.lit(1))
        got = sent.groupBy(F.col("dst").alias("node")).agg(F.sum(share).alias("more"))
        both = active.join(got, "node", "full")
        total = F.least(F.lit(1.0), F.coalesce("activation", F.lit(0.0)) + F.coalesce("more", F.lit(0.0)))
        nxt = materialize(both.select("node", total.alias("activation"), F.col("more").isNotNull().alias("hit")), "spread")
        frontier = nxt.where("hit").select("node").join(seed, "node", "left_anti")
        active = nxt.select("node", "activation")
    return active.join(seed.select("node"), "node", "left_anti").where(F.col("activation") >= threshold)


def activated(active: DataFrame, scores: DataFrame, k: int = 5, vector: float = 0.7, activation: float = 0.3) -> DataFrame:
    """(node, activation, hybrid, place): the ``k`` most active nodes (node, activation), ties by node, in the order of a weighted sum of
    their vector score (node, score), 0 without one, and their activation."""
    best = active.orderBy(F.desc("activation"), "node").limit(k)
    hybrid = F.round(vector * F.coalesce("score", F.lit(0.0)) + activation * F.col("activation"), 6)
    # At most k rows are ranked.
    place = F.row_number().over(Window.orderBy(F.desc("hybrid"), "node"))
    return best.join(scores, "node", "left").select("node", "activation", hybrid.alias("hybrid")).withColumn("place", place)


def innermost(points: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """(point, span): for (file, line, point) the span (file, start, end, span) with the largest start that
    holds the line, the shorter on a tie. Spans are exploded into buckets of ``width`` lines."""
    b = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    p = points.withColumn("bucket", F.floor(F.col("line") / width))
    hit = p.join(b, ["file", "bucket"]).where("line BETWEEN start AND end")
    return hit.groupBy("point").agg(F.max_by("span", F.struct("start", -F.col("end"), "span")).alias("span"))


def shortest_path_lengths(source: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    return closure(source, edges, most)


def link_findings(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """(finding, symbol, level): references of findings' tokens (finding, token, exact) to symbols (symbol,
    name, is_type). A type's name, or any name met in code form, is high (2); a unique distinctive
    identifier is medium (1). The best level per pair stays."""
    uses = symbols.groupBy("name").agg(F.count_distinct("symbol").alias("n"))
    known = symbols.join(uses, "name")
    distinctive = (F.length("name") >= 8) & F.col("name").rlike("[A-Z]") & (F.col("name").rlike("[a-z]") | F.col("name").rlike("^[A-Z0-9_]+$"))
    hit = tokens.join(known, F.col("token") == F.col("name"))
    level = F.when(F.col("is_type") | F.col("exact"), 2).when((F.col("n") == 1) & distinctive, 1)
    return hit.select("finding", "symbol", level.alias("level")).where("level IS NOT NULL").groupBy("finding", "symbol").agg(F.max("level").alias("level"))


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(call, symbol, rung) for calls (call, name, owner, file) over symbols (symbol, name, owner, file):
    the caller's class, then its file, then a name that is unique. Each rung is a join on equal keys."""
    key = lambda *cols: symbols.groupBy(*cols).agg(F.min("symbol").alias("symbol"), F.count_distinct("symbol").alias("n")).where("n = 1").drop("n")
    a = key("name", "owner").withColumnRenamed("symbol", "s1")
    b = key("name", "file").withColumnRenamed("symbol", "s2")
    c = key("name").withColumnRenamed("symbol", "s3")
    out = calls.join(a, ["name", "owner"], "left").join(b, ["name", "file"], "left").join(c, "name", "left")
    rung = F.when(F.col("s1").isNotNull(), "class").when(F.col("s2").isNotNull(), "file").when(F.col("s3").isNotNull(), "unique").otherwise("unresolved")
    return out.select("call", F.coalesce("s1", "s2", "s3").alias("symbol"), rung.alias("rung"))


def without_path(nodes: DataFrame, path: str) -> DataFrame:
    """Nodes that are not the path or below it."""
    return nodes.where(~((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/")))


def read_only(statement: str) -> bool:
    """Whether a query over the graph's views only reads."""
    import re

    head = re.match(r"\s*(select|with|match|show|describe|explain)\b", statement, re.IGNORECASE)
    writes = re.search(r"\b(create|merge|delete|detach|set|remove|drop|alter|copy|insert|update|load|truncate|install|attach)\b", statement, re.IGNORECASE)
    return bool(head) and not writes
