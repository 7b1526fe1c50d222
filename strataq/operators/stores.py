"""Stores that are tables: verdicts, the mirrored graph, ledgers, and the jobs that keep them.

An update gives the new table; ``sources.logs`` writes it beside the old one and swaps it in. Merges are
one union and one aggregation by key, so a batch of any size costs one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.functions import scoring as S
from strataq.functions import text as X
from strataq.operators import graph, metrics, retrieval
from strataq.operators.windows import top_per_key

BLOCKING = ("block", "reject", "deny")
VERDICT = ("signature", "kind", "verdict_type", "decision", "confidence", "rationale", "occurrences", "first_seen", "last_seen", "excerpt")


def verdict_signature(kind: Column, excerpt: Column) -> Column:
    return F.sha2(F.concat(kind, F.lit(":"), X.squeeze(excerpt)), 256)


def recorded(store: DataFrame, new: DataFrame) -> DataFrame:
    """The verdict store (VERDICT) after ``new`` verdicts of distinct signatures: a known one counts one more than the greater
    count, keeps its first and takes the last time it was seen, and the decision with the higher confidence, the known one's on a tie."""
    both = store.select(*VERDICT, F.lit(0).alias("_new")).unionByName(new.select(*VERDICT, F.lit(1).alias("_new")))
    best = F.max_by(F.struct("verdict_type", "decision", "confidence", "rationale"), F.struct("confidence", -F.col("_new"))).alias("b")
    known = F.min("_new") != F.max("_new")
    out = both.groupBy("signature").agg(
        best, F.min_by(F.struct("kind", "excerpt"), "_new").alias("s"), F.min_by("first_seen", "_new").alias("first_seen"), F.max_by("last_seen", "_new").alias("last_seen"),
        (F.max("occurrences") + known.cast("int")).alias("occurrences"),
    )
    return out.select("signature", "s.kind", "b.verdict_type", "b.decision", "b.confidence", "b.rationale", "occurrences", "first_seen", "last_seen", "s.excerpt")


def recalled(queries: DataFrame, store: DataFrame, kind: str, k: int, places: int | None = None) -> DataFrame:
    """(query, id, score, place): the nearest verdicts (id, kind, vec) of a kind to a query set (query, vec)."""
    return retrieval.knn(queries, store.where(F.col("kind") == kind).select("id", "vec"), k, places=places)


def verdict_counts(store: DataFrame) -> DataFrame:
    """(total_verdicts, recurring_blocks): all verdicts, and those that block and were met twice or more. Counts the whole store."""
    again = (F.col("occurrences") >= 2) & F.col("decision").isin(*BLOCKING)
    return store.agg(F.count("*").alias("total_verdicts"), F.count(F.when(again, 1)).alias("recurring_blocks"))


def forgotten(store: DataFrame, subjects: DataFrame) -> DataFrame:
    """The store without the verdicts on ``subjects`` (kind, excerpt)."""
    gone = subjects.select(verdict_signature(F.col("kind"), F.col("excerpt")).alias("signature"))
    return store.join(gone, "signature", "left_anti")


def mirrored(found: DataFrame, mentions: DataFrame) -> dict[str, DataFrame]:
    """The graph of findings (id, investigation_id, record_type, text, confidence, source, created_at_ts, derived_from array) and mentions (id, entity, etype):
    tables of finding, investigation and entity nodes, and the edges between them. Parents that are no findings become placeholders."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    own = found.where(F.coalesce("id", F.lit("")) != "")
    nodes = own.select("id", blank("investigation_id"), blank("record_type"), blank("text"), blank("confidence"), blank("source"), F.coalesce("created_at_ts", F.lit(0)).alias("created_at_ts"))
    derived = own.select(F.col("id").alias("src"), F.explode(X.parents_of(F.col("derived_from"))).alias("dst")).distinct()
    missing = derived.select(F.col("dst").alias("id")).distinct().join(own.select("id"), "id", "left_anti")
    empty = [F.lit("").alias(c) for c in ("investigation_id", "record_type", "text", "confidence", "source")]
    return {
        "findings": nodes.unionByName(missing.select("id", *empty, F.lit(0).alias("created_at_ts"))),
        "investigations": own.where(F.coalesce("investigation_id", F.lit("")) != "").select(F.col("investigation_id").alias("id")).distinct(),
        "entities": mentions.where("entity <> ''").groupBy("entity").agg(F.max("etype").alias("etype")),
        "in_investigation": own.where(F.coalesce("investigation_id", F.lit("")) != "").select(F.col("id").alias("src"), F.col("investigation_id").alias("dst")).distinct(),
        "mentions": mentions.where("entity <> ''").join(own.select("id"), "id", "left_semi").select(F.col("id").alias("src"), F.col("entity").alias("dst")).distinct(),
        "derived_from": derived,
    }


def merged_rows(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Set-based upsert: rows of ``new`` replace those with their key, others are added."""
    last = new.groupBy(key).agg(F.max(F.struct(*[c for c in base.columns if c != key])).alias("_r")).select(key, "_r.*").select(*base.columns)
    return base.join(last.select(key), key, "left_anti").unionByName(last)


def referenced(references: DataFrame, findings: DataFrame, symbols: DataFrame) -> DataFrame:
    """References (finding, symbol) whose ends both exist."""
    return references.join(findings.select(F.col("id").alias("finding")), "finding", "left_semi").join(symbols.select(F.col("id").alias("symbol")), "symbol", "left_semi").select("finding", "symbol").distinct()


def merged_nodes(rows: DataFrame, order: str) -> DataFrame:
    """(id, path, line, attrs) of node rows (id, path, line, attrs map, and an order): the first path and line that are known, attributes with the last value of each key."""
    last = rows.select("id", order, F.explode_outer("attrs").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", order).alias("v"))
    attrs = last.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v"))))).alias("attrs"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return rows.groupBy("id").agg(first("path"), first("line")).join(attrs, "id")


def ranked_flags(bindings: DataFrame, accumulators: bool = False) -> DataFrame:
    """(id, path, line, pattern, score): locals with a constant start, by guard exits a rebind.

    Bindings are (id, path, line, init_is_constant, assign_forms, constant_rebinds, guard_exits). A local that is
    updated in place, or only ever to computed values, is an accumulator and left out unless asked for.
    """
    pattern = F.when(F.size("assign_forms") == 0, "flag").when(F.array_contains("assign_forms", "augmented"), "accumulator").when(F.col("constant_rebinds") > 0, "flag").otherwise("accumulator")
    rows = bindings.where("init_is_constant").withColumn("pattern", pattern).withColumn("score", F.col("guard_exits") / F.greatest(F.lit(1), F.col("constant_rebinds")))
    rows = rows if accumulators else rows.where("pattern = 'flag'")
    return rows.orderBy(F.desc("score"), F.coalesce("path", F.lit("")), F.coalesce("line", F.lit(0))).select("id", "path", "line", "pattern", "score")


def canary(runs: DataFrame, threshold: float, margin: float = 0.02, least: int = 10) -> DataFrame:
    """(n_runs, n_findings, base_f1, base_std, model_f1, model_std, delta, decision) of scored pairs (run, finding, label, base, model).

    Runs of fewer than ``least`` findings are left out; means and population deviations are over runs. The model
    is promoted if its mean F1 is ``margin`` better or more.
    """
    big = runs.groupBy("run").agg(F.count_distinct("finding").alias("_n")).where(F.col("_n") >= least)
    rows = runs.join(big, "run")
    f1 = lambda c: F.coalesce(2.0 * F.sum(((F.col(c) >= threshold) & (F.col("label") == 1)).cast("long")) / F.nullif(F.sum((F.col(c) >= threshold).cast("long")) + F.sum((F.col("label") == 1).cast("long")), F.lit(0)), F.lit(0.0))
    per = rows.groupBy("run").agg(F.max("_n").alias("n"), f1("base").alias("b"), f1("model").alias("m"))
    out = per.agg(F.count("*").alias("n_runs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_findings"), F.avg("b").alias("base_f1"), F.stddev_pop("b").alias("base_std"), F.avg("m").alias("model_f1"), F.stddev_pop("m").alias("model_std"))
    out = out.withColumn("delta", F.col("model_f1") - F.col("base_f1"))
    return out.withColumn("decision", F.when(F.col("delta") >= margin, "PROMOTE").otherwise("HOLD"))


def promotion(ledger: DataFrame, model: str, sha256: str, measures: str, at: str) -> DataFrame:
    """The ledger entry (promoted_at, model, metrics, sha256, previous_sha256) of a model that takes the place of its last one."""
    last = ledger.where(F.col("model") == model).agg(F.max_by("sha256", "promoted_at").alias("previous_sha256"))
    return last.select(F.lit(at).alias("promoted_at"), F.lit(model).alias("model"), F.lit(measures).alias("metrics"), F.lit(sha256).alias("sha256"), "previous_sha256")


def causal_list(edges: DataFrame, investigation: str | None = None) -> DataFrame:
    """Causal edges with their columns cast: confidence as a number, 0 where it is none, ids and type as text."""
    rows = edges.where(F.col("investigation_id") == investigation) if investigation else edges
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return rows.select(text("source_id"), text("target_id"), text("edge_type"), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)).alias("confidence"), text("inferred_at"))


def latest_tail(found: DataFrame, least: int = 3, last: int = 10) -> DataFrame:
    """The ``last`` findings of the investigation that was written to last, among those with ``least`` findings or more."""
    newest = found.groupBy("investigation_id").agg(F.count("*").alias("n"), F.max("created_at_ts").alias("t")).where(F.col("n") >= least).orderBy(F.desc("t"), "investigation_id").limit(1)
    rows = found.join(F.broadcast(newest.select("investigation_id")), "investigation_id")
    return rows.orderBy(F.desc("created_at_ts"), F.desc("seq")).limit(last)


def correlated(found: DataFrame, mentions: DataFrame, suspects: DataFrame, parents: DataFrame) -> DataFrame:
    """(node, reason): findings that name a suspect (token), as an entity or as one of the tokens of their text (id, tokens), and whatever they contaminate."""
    s = suspects.select(F.lower("token").alias("token")).distinct()
    named = mentions.select("node", F.lower("entity").alias("token")).join(s, "token", "left_semi").select("node")
    said = found.select(F.col("id").alias("node"), F.explode("tokens").alias("token")).join(s, "token", "left_semi").select("node")
    return graph.contamination(named.union(said).distinct(), mentions, parents)


def replay_batch(found: DataFrame, now: int, hours: float = 6.0, k: int = 7) -> DataFrame:
    """The ``k`` findings of the last ``hours`` that are most worth replaying, consolidated ones left out."""
    score = S.replay_priority(F.col("created_at_ts"), F.col("importance"), F.col("confidence"), F.col("recall_count"), now)
    rows = found.where((F.col("created_at_ts") >= now - hours * 3600) & (F.col("record_type") != "consolidated"))
    return rows.withColumn("priority", F.round(score, 9)).orderBy(F.desc("priority"), "seq").limit(k)


def consolidated(batch: DataFrame, near: DataFrame, answer: Column, at: int) -> DataFrame:
    """One finding that stands for a batch: ``answer`` over its texts and those of the ``near`` consolidated ones, derived from the batch."""
    listed = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct("seq", "id", F.substring("text", 1, 200).alias("t")))).alias(name))
    one = listed(batch, "batch").crossJoin(listed(near, "near"))
    return one.select(
        answer.alias("text"), F.lit("consolidated").alias("record_type"), F.lit("medium").alias("confidence"), F.lit(0.75).alias("importance"), F.transform("batch", lambda x: x["id"]).alias("derived_from"),
        F.lit(at).alias("created_at_ts"), F.size("batch").alias("batch_size"), F.size("near").alias("interleaved"),
    )


def relabelled(fails: DataFrame, answer: str = "answer") -> DataFrame:
    """(id, content, importance) of failures (id, content, answer) that a model could see as a success of another goal; other answers are left out."""
    good = F.col(answer).startswith("This trace") & (F.length(answer) > 20)
    text = F.concat(F.lit("RELABELLED: "), F.col(answer), F.lit("\nOriginal: "), F.substring("content", 1, 200))
    return fails.where(good).select(X.stable_id(text).alias("id"), text.alias("content"), F.lit(6).alias("importance"), F.col("id").cast("string").alias("original_id"))


def reembedded(rows: DataFrame, stale: DataFrame, embed: Column, model: str, version: int) -> DataFrame:
    """Rows (id, text, vec, model, version) with the vectors of the ``stale`` (id) ones made anew."""
    hit = rows.join(stale.select("id", F.lit(True).alias("_old")), "id", "left")
    old = F.coalesce("_old", F.lit(False))
    return hit.select("id", "text", F.when(old, embed).otherwise(F.col("vec")).alias("vec"), F.when(old, model).otherwise(F.col("model")).alias("model"), F.when(old, version).otherwise(F.col("version")).alias("version"))


def anchors(rows: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` texts, by hash of their id, whose vectors of today later ones are held against."""
    return metrics.sampled(rows, "id", n, "anchor").select("id", "text", "vec")


def drift(anchor: DataFrame, live: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(mean_cosine, drift_score, n_drifted, n_texts, exceeded): anchors (id, vec) against the vectors they have now."""
    both = anchor.select("id", F.col("vec").alias("a")).join(live.select("id", F.col("vec").alias("b")), "id").select(S.cosine(F.col("a"), F.col("b")).alias("c"))
    out = both.agg(F.avg("c").alias("mean_cosine"), F.count(F.when(F.col("c") < 1 - threshold, 1)).alias("n_drifted"), F.count("*").alias("n_texts"))
    return out.select("mean_cosine", (1 - F.col("mean_cosine")).alias("drift_score"), "n_drifted", "n_texts", (1 - F.col("mean_cosine") > threshold).alias("exceeded"))


def lookup_in(mentions: DataFrame, entity: str, investigation: str | None, limit: int) -> DataFrame:
    """Findings (id, entity, investigation_id, created_at_ts) that mention an entity; the investigation counts before the limit."""
    rows = mentions.where(F.lower("entity") == entity.lower())
    rows = rows.where(F.col("investigation_id") == investigation) if investigation else rows
    return rows.orderBy(F.desc("created_at_ts"), "id").limit(limit).select("id", "investigation_id")


def recall_rows(hits: DataFrame, investigation: str | None, limit: int) -> DataFrame:
    """Hits (query, id, score, content, metadata map) as findings of an investigation, without empty texts, the best ``limit`` a query."""
    inv = F.coalesce(F.col("metadata")["investigation_id"], F.col("metadata")["investigation"], F.lit(""))
    rows = hits.select("query", "id", "score", F.trim(F.coalesce("content", F.lit(""))).alias("text"), inv.alias("investigation_id"), F.coalesce(F.col("metadata")["confidence"], F.lit("low")).alias("confidence"))
    rows = rows.where(F.col("investigation_id") == investigation) if investigation else rows
    return top_per_key(rows.where("text <> ''"), ["query"], [F.desc("score"), F.asc("id")], limit)


TIERS = ("cold", "warm", "hot")


def tier_moved(tier: Column, up: bool) -> Column:
    """The next tier in TIERS, or the same at either end; an unknown tier counts as warm."""
    at = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TIERS)), tier), F.lit(0)), F.lit(2))
    to = F.least(at + 1, F.lit(len(TIERS))) if up else F.greatest(at - 1, F.lit(1))
    return F.element_at(F.array(*map(F.lit, TIERS)), to.cast("int"))


def resolved_conflict(conflicts: DataFrame, a: str, b: str, outcome: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(conflicts, retired): the pair (finding_id_a, finding_id_b) with its outcome, and the finding that loses; none where both are valid or it was no conflict."""
    if outcome not in ("a_wins", "b_wins", "both_valid", "false_positive"):
        raise ValueError(f"unknown outcome {outcome}")
    here = (F.col("finding_id_a") == a) & (F.col("finding_id_b") == b)
    out = conflicts.withColumns({"status": F.when(here, outcome).otherwise(F.col("status")), "resolved_at": F.when(here, at)})
    loser = {"a_wins": "finding_id_b", "b_wins": "finding_id_a"}.get(outcome)
    gone = conflicts.where(here).select(F.col(loser or "finding_id_a").alias("id"))
    return out, gone if loser else gone.limit(0)


def triples_added(store: DataFrame, new: DataFrame) -> DataFrame:
    """Triples (subject, predicate, object, created_at_ts): those of ``new`` that the store has not, once each with their first time, are added."""
    key = ["subject", "predicate", "object"]
    fresh = new.groupBy(*key).agg(F.min("created_at_ts").alias("created_at_ts")).join(store.select(*key), key, "left_anti")
    return store.unionByName(fresh.select(*store.columns))


def recurring_traces(log: DataFrame, kinds: tuple[str, ...], least: int = 2) -> DataFrame:
    """(kind, signature, count, last) of log entries (kind, text, ts) of some kinds, by canonical text, met ``least`` times or more."""
    rows = log.where(F.col("kind").isin(*kinds)).withColumn("signature", X.canonical_signature(F.col("text")))
    return rows.groupBy("kind", "signature").agg(F.count("*").alias("count"), F.max("ts").alias("last")).where(F.col("count") >= least)




def code_verdicts(rows: DataFrame, at: int, blocking: float = 0.6) -> DataFrame:
    """Rule rows of ``functions.code`` as verdicts (VERDICT) on their lines: they block from a pattern confidence of ``blocking`` on."""
    from strataq.functions import rules

    patterns = {p: c for p, _, _, _, c in rules.catalogue()}
    known = F.create_map(*(F.lit(x) for r in rules.RULES for x in (r.code, patterns[r.pattern])))
    found = rows.where("kind = 'rule'").withColumn("confidence", F.element_at(known, F.col("detail")))
    excerpt = F.concat_ws(":", "path", F.col("line").cast("string"), "detail")
    return found.select(
        verdict_signature(F.lit("code"), excerpt).alias("signature"), F.lit("code").alias("kind"), F.col("detail").alias("verdict_type"), F.when(F.col("confidence") >= blocking, "block").otherwise("warn").alias("decision"),
        "confidence", F.col("name").alias("rationale"), F.lit(1).cast("long").alias("occurrences"), F.lit(at).cast("long").alias("first_seen"), F.lit(at).cast("long").alias("last_seen"), excerpt.alias("excerpt"),
    )


def ingested(rows: DataFrame) -> dict[str, DataFrame]:
    """Parsed files (``functions.code``) as graph tables: symbols, their containers, resolved calls and imports."""
    from strataq.functions import code

    defs = rows.where("kind IN ('function', 'async_function', 'class')").select(F.concat_ws("::", "path", "name").alias("id"), "path", "name", "kind", "line", "end_line", F.when(F.col("owner") != "", F.concat_ws("::", "path", "owner")).alias("parent"))
    caller = rows.where("kind = 'call'").select("path", "line", "name", F.when(F.col("owner") != "", F.concat_ws("::", "path", "owner")).otherwise(F.col("path")).alias("src")).distinct()
    calls = code.resolve_python_calls(rows).where("rung <> '?'").join(caller, ["path", "line", "name"]).select("src", F.col("target").alias("dst"), "rung").distinct()
    return {
        "symbols": defs.drop("parent"), "contains": defs.select(F.coalesce("parent", "path").alias("src"), F.col("id").alias("dst")), "calls": calls,
        "imports": code.import_map(rows).select(F.col("path").alias("src"), F.col("fqn").alias("dst")),
    }


def fact_lines(impact: DataFrame) -> DataFrame:
    """(symbol, line): sentences on what hangs on a symbol, from (symbol, callers, findings, related array)."""
    some = F.array_join(F.slice(F.col("related"), 1, 4), ", ")
    line = F.concat_ws(" ", F.col("symbol").cast("string"), F.lit("has"), F.col("callers").cast("string"), F.lit("callers and"), F.col("findings").cast("string"), F.lit("findings."), F.when(F.size("related") > 0, F.concat(F.lit("Seen with "), some, F.lit("."))))
    return impact.select("symbol", line.alias("line"))


def swept(verdicts: DataFrame, edges: DataFrame, nodes: DataFrame, losers: DataFrame, new_runs: int, new_pairs: int, runs: int = 2, pairs: int = 200) -> dict[str, DataFrame]:
    """What a sweep leaves, by table, or nothing if too little is new: the best verdict of each signature (signature, confidence, last_seen, ...),
    edges (src, dst) whose ends exist, and nodes (id) that some edge touches and that no near duplicate outweighs (``losers``)."""
    if new_runs < runs or new_pairs < pairs:
        return {}
    best = top_per_key(verdicts, ["signature"], [F.desc("confidence"), F.desc("last_seen")], 1)
    end = lambda c: nodes.select(F.col("id").alias(c))
    held = edges.join(end("src"), "src", "left_semi").join(end("dst"), "dst", "left_semi").select("src", "dst")
    touched = held.select(F.col("src").alias("id")).union(held.select("dst")).distinct()
    return {"verdicts": best, "edges": held, "nodes": nodes.join(touched, "id", "left_semi").join(losers.select("id"), "id", "left_anti")}


def advanced(since: str | None, rows: DataFrame, ts: str, clean: bool) -> str | None:
    """The watermark after a sync: the newest moment delivered, but only if the run was clean."""
    newest = rows.agg(F.max(ts)).first()[0] if clean else None
    return max(filter(None, (since, newest)), default=None)


#: What a reflection starts from; a stored state may lack any of it.
REFLECTION = {"status": "idle", "ticks": 0, "last_tick": None, "queue": [], "seen": []}


def reflection_state(stored: dict | None) -> dict:
    """A stored reflection state with the defaults for what it lacks; unknown fields stay."""
    return {k: list(v) if isinstance(v, list) else v for k, v in REFLECTION.items()} | {k: v for k, v in (stored or {}).items() if v is not None}


def seeded(state: dict, questions: list[str]) -> dict:
    """The state with questions it has not seen at the end of its queue."""
    known = {*state["queue"], *state["seen"]}
    fresh = [q for k, q in enumerate(questions) if q and q not in known and q not in questions[:k]]
    return state | {"queue": [*state["queue"], *fresh], "status": "queued" if state["queue"] or fresh else state["status"]}


def ticked(state: dict, at: str) -> tuple[str | None, dict]:
    """The next question of the queue, and the state after it."""
    if not state["queue"]:
        return None, state | {"status": "idle"}
    first, *rest = state["queue"]
    return first, state | {"queue": rest, "seen": [*state["seen"], first], "ticks": state["ticks"] + 1, "last_tick": at, "status": "queued" if rest else "idle"}
