"""The engine's tools as compositions: search, precheck, conflicts, retraction, notes, contracts, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataq.functions import scoring as S
from strataq.functions import text as X
from strataq.operators import folds, graph, pairs, retrieval
from strataq.operators.windows import top_per_key


def search(hits: DataFrame, found: DataFrame, retracted: DataFrame, overrides: DataFrame, floor: str = "low", resolution: str | None = None, limit: int = 10) -> DataFrame:
    """Ranked hits (query, id, score) as findings: retracted ones and their repeats leave, a confidence floor and a
    resolution may apply, of rows with the same key the best stays, then the best ``limit`` per query."""
    live = folds.with_lifecycle(folds.without_retracted(found, retracted), overrides)
    live = live.where(folds.confidence_at_least(F.col("confidence"), floor))
    live = live.where(F.col("resolution") == resolution) if resolution in folds.RESOLUTIONS else live
    rows = hits.join(live, "id")
    key = F.sha2(F.concat_ws("|", "investigation_id", "record_type", F.substring("text", 1, 220)), 256)
    rows = top_per_key(rows.withColumn("_key", key), ["query", "_key"], [F.desc("score"), F.asc("id")], 1).drop("_key")
    return retrieval.top_k(rows, limit)


def route(hits: DataFrame, found: DataFrame, agent: str, acl: DataFrame, limit: int, same: float = 0.8) -> DataFrame:
    """Hits that an agent may see: its own or those of investigations (investigation_id, acl) that list their author;
    near copies by word overlap leave in score order."""
    rows = hits.join(found, "id").join(acl.select(F.col("investigation_id").alias("_inv"), "acl"), F.col("investigation_id") == F.col("_inv"), "left")
    rows = rows.where((F.col("authored_by") == agent) | F.coalesce(F.array_contains("acl", F.col("authored_by")), F.lit(False)))
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[ \\t\\n]+"), lambda w: w != ""))
    ranked = rows.select("query", "id", "score", words.alias("tokens")).withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
    ranked = ranked.where(F.col("place") <= 3 * limit)
    other = ranked.select("query", F.col("place").alias("p2"), F.col("tokens").alias("t2"))
    # At most 3 * limit rows a query: pairs within a query are bounded.
    copies = ranked.join(other, "query").where((F.col("p2") < F.col("place")) & (S.jaccard(F.col("tokens"), F.col("t2")) > same)).select("query", "place").distinct()
    return retrieval.top_k(ranked.join(copies, ["query", "place"], "left_anti").drop("place", "tokens"), limit)


def precheck(lexical: DataFrame, semantic: DataFrame, least: float, limit: int = 10) -> DataFrame:
    """(query, id, score, lane): lexical evidence at ``least`` or above, up to ``limit``, and semantic evidence at
    max(least, .5); an id of both lanes counts as lexical."""
    lex = retrieval.top_k(lexical.where(F.col("score") >= least), limit).select("query", "id", "score", F.lit(1).alias("lane"))
    sem = semantic.where(F.col("score") >= max(least, 0.5)).select("query", "id", "score", F.lit(2).alias("lane"))
    best = lex.unionByName(sem).groupBy("query", "id").agg(F.min(F.struct("lane", "score")).alias("b"))
    return best.select("query", "id", F.col("b.score").alias("score"), F.when(F.col("b.lane") == 1, "lexical").otherwise("semantic").alias("lane"))


def conflicts(near: DataFrame, found: DataFrame) -> DataFrame:
    """Neighbours (query, id, score) of new findings that conflict: a gap that an observed one fills, an assumption
    that another kind overrides, or opposite negation."""
    side = lambda k, p: found.select(F.col("id").alias(k), F.col("record_type").alias(f"{p}_type"), X.has_negation_marker(F.col("text")).alias(f"{p}_neg"))
    both = near.join(side("query", "new"), "query").join(side("id", "old"), "id")
    clash = ((F.col("old_type") == "gap") & (F.col("new_type") == "observed")) | ((F.col("old_type") == "assumed") & (F.col("new_type") != "assumed")) | (F.col("new_neg") != F.col("old_neg"))
    return both.where(clash).select("query", "id", F.round("score", 4).alias("score"))


def hallucination_candidates(tallies: DataFrame) -> DataFrame:
    """ids of contradicting findings that lack support while the other side has it, by their ``contradiction_counts``."""
    return tallies.where("candidate").select("id")


def entity_lookup(found: DataFrame, mentions: DataFrame, entity: str) -> DataFrame:
    """Findings that mention an entity: by stored equality, or by the text with no letter or digit beside it."""
    stored = mentions.where(F.lower("entity") == entity.lower()).select("id").distinct()
    import re

    bounded = f"(?i)(?<![A-Za-z0-9]){re.escape(entity)}(?![A-Za-z0-9])"
    return found.where(F.col("text").rlike(bounded)).select("id").union(stored).distinct()


def retract(found: DataFrame, seeds: DataFrame, mentions: DataFrame, at: int, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cluster, tombstones) of a retraction: what is contaminated and why, and the log entries and end of validity
    that a real run appends; a dry run has none."""
    parents = found.where("derived_from IS NOT NULL").select(F.col("id").alias("child"), F.col("derived_from").alias("parent"))
    cluster = graph.contamination(seeds, mentions, parents)
    stones = cluster.select(F.col("node").alias("finding_id"), "reason", F.lit(at).alias("valid_until"), F.lit(True).alias("active"))
    return cluster, stones.limit(0) if dry_run else stones


def restore(tombstones: DataFrame) -> DataFrame:
    """Log entries that undo a retraction."""
    return tombstones.select("finding_id", F.lit("restored").alias("reason"), F.lit(None).cast("long").alias("valid_until"), F.lit(False).alias("active"))


def noted(manifests: DataFrame, id_: str, field: str, value: str, now: str) -> DataFrame:
    """A manifest with a note: a scalar with its time, a question added or, with a leading minus, removed, a checked
    source ``tool: summary`` split at its last colon, or closed."""
    here = F.col("id") == id_
    if field == "question":
        own = F.array_except("open_questions", F.array(F.lit(value[1:]))) if value.startswith("-") else F.array_union("open_questions", F.array(F.lit(value)))
        return manifests.withColumn("open_questions", F.when(here, own).otherwise(F.col("open_questions")))
    if field == "checked_source":
        tool, _, summary = value.rpartition(":")
        entry = F.create_map(F.lit(tool.strip()), F.lit(summary.strip()))
        return manifests.withColumn("checked_sources", F.when(here, F.map_concat(F.map_filter("checked_sources", lambda k, v: k != tool.strip()), entry)).otherwise(F.col("checked_sources")))
    if field == "close":
        return manifests.withColumn("status", F.when(here, "closed").otherwise(F.col("status"))).withColumn("closed_at", F.when(here, now).otherwise(F.col("closed_at")))
    return manifests.withColumn(field, F.when(here, value).otherwise(F.col(field))).withColumn(f"{field}_ts", F.when(here, now))


def summaries(found: DataFrame) -> DataFrame:
    """Per investigation the brief and the one-line form of its findings."""
    last = folds.last_n(found, ["investigation_id"], "seq", 5).groupBy("investigation_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.substring("text", 1, 100).alias("t")))).alias("l"))
    n = found.groupBy("investigation_id").agg(F.count("*").alias("n"))
    line = F.concat(F.lit("Investigation with "), F.col("n").cast("string"), F.lit(" findings. Latest: "), F.element_at("l", -1)["t"])
    return last.join(n, "investigation_id").select("investigation_id", F.array_join(F.transform("l", lambda x: x["t"]), " | ").alias("brief"), line.alias("line"))


def contract(entity: str, role: str, fields: str, protocol: str) -> dict | None:
    """The gap finding that declares a contract, or None where ``fields`` is no JSON object."""
    import json

    try:
        if not isinstance(json.loads(fields), dict):
            return None
    except ValueError:
        return None
    return {"record_type": "gap", "text": f"Contract {entity} as {role}: fields={fields} protocol={protocol}", "tags": ["contract_declaration", f"entity:{entity}", f"role:{role}", f"protocol:{protocol}"]}


def contracts(found: DataFrame, entity: str, role: str | None = None) -> DataFrame:
    """Contract declarations of an entity, by tags."""
    rows = found.where(F.array_contains("tags", "contract_declaration") & F.array_contains("tags", f"entity:{entity}"))
    return rows.where(F.array_contains("tags", f"role:{role}")) if role else rows


def judged_contradictions(similar: DataFrame, found: DataFrame, least: float = 0.62, most: int = 40) -> DataFrame:
    """The closest pairs (a, b, similarity) of opposite polarity: what a judge is asked about."""
    side = lambda k: found.select(F.col("id").alias(k), X.is_negated(F.col("text")).alias(f"{k}_n"))
    both = similar.where(F.col("similarity") >= least).join(side("a"), "a").join(side("b"), "b")
    return both.where("a_n <> b_n").orderBy(F.desc("similarity"), "a", "b").limit(most).select("a", "b", "similarity")


def coalesced_verdicts(verdicts: DataFrame, threshold: float = 0.97) -> DataFrame:
    """(kind, rep, occurrences) of (vec_id, kind, vec): a verdict joins the earliest kept one of its kind that is near."""
    same = pairs.similar_vectors(verdicts, threshold, same="kind").select("a", "b")
    reps = pairs.greedy_representatives(verdicts, same)
    return reps.join(verdicts.select("vec_id", "kind"), "vec_id").groupBy("kind", "rep").agg(F.count("*").alias("occurrences"))


def judge_pools(rankings: DataFrame, k: int) -> DataFrame:
    """(query, id): what any configuration ranks among its first ``k``."""
    return rankings.where(F.col("place") <= k).select("query", "id").distinct()


def leave_one_out(scored: DataFrame, run: str, label: str, score: str, steps: int = 71, low: float = 0.3, high: float = 1.0) -> DataFrame:
    """(run, threshold, f1): per run the threshold that is best on all other runs, and its F1 on the run. Counts per
    run and threshold are aggregated first; runs only meet as sums."""
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.lit(low) + i * ((high - low) / (steps - 1))))
    hit = scored.withColumn("threshold", grid)
    keep = (F.col(score) >= F.col("threshold")).cast("long")
    good = (F.col(label) == 1).cast("long")
    per = hit.groupBy(run, "threshold").agg(F.sum(keep * good).alias("tp"), F.sum(keep).alias("kept"), F.sum(good).alias("pos"))
    w = Window.partitionBy("threshold")
    rest = lambda c: F.sum(c).over(w) - F.col(c)
    f1 = lambda tp, kept, pos: F.when(kept + pos > 0, 2.0 * tp / (kept + pos)).otherwise(0.0)
    both = per.withColumn("train", f1(rest("tp"), rest("kept"), rest("pos"))).withColumn("f1", f1(F.col("tp"), F.col("kept"), F.col("pos")))
    best = both.groupBy(run).agg(F.max(F.struct("train", (-F.col("threshold")).alias("t"), "f1")).alias("b"))
    return best.select(run, (-F.col("b.t")).alias("threshold"), F.col("b.f1").alias("f1"))


def train_critic(samples: DataFrame, least: int = 50):
    """A logistic regression on (features array, label), or None with fewer than ``least`` samples."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    if samples.limit(least).count() < least:
        return None
    return LogisticRegression(regParam=0.01).fit(samples.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label")))


def edge_lists(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree): degrees of every node; neighbours stay in the edge table."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    in_ = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.join(out, "node", "left").join(in_, "node", "left").select("node", zero("out_degree"), zero("in_degree"))


def loop_gate(new_runs: Column, new_pairs: Column, runs: int = 2, pairs_: int = 200) -> Column:
    return (new_runs >= runs) & (new_pairs >= pairs_)


def changed_sessions(now: DataFrame, cache: DataFrame) -> DataFrame:
    """Sessions (session_id, messages) whose message count is not the cached one."""
    known = cache.select("session_id", F.col("messages").alias("_m"))
    return now.join(known, "session_id", "left").where(~F.col("messages").eqNullSafe(F.col("_m"))).select("session_id", "messages")
