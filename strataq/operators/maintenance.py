"""Memory maintenance: decay, sweeps, consolidation choices and dataset rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.functions import scoring as S
from strataq.operators.folds import is_garbage_fact, latest_rows
from strataq.operators.pairs import sharing


def decayed(found: DataFrame, now: int, floor: float = 0.05) -> DataFrame:
    """Adds Weibull ``retention`` and the importance that decay leaves, at least ``floor``."""
    kept = found.withColumn("retention", S.weibull_retention(S.age_days(F.col("created_at_ts"), now)))
    return kept.withColumn("decayed", F.greatest(F.lit(floor), F.col("importance") * F.col("retention")))


def decay_summary(found: DataFrame, now: int) -> DataFrame:
    d = decayed(found, now)
    changed = (F.abs(F.col("decayed") - F.col("importance")) > 1e-6).cast("long")
    return d.agg(F.count("*").alias("n_rows"), F.sum(changed).alias("n_decayed"), F.round(F.avg("retention"), 9).alias("mean_retention"), F.round(F.min("retention"), 9).alias("min_retention"))


def refresh_candidates(found: DataFrame, now: int, below: float = 0.3, limit: int = 50) -> DataFrame:
    """The most forgotten findings: stability retention under ``below``, least first."""
    d = S.initial_difficulty(F.col("importance") * 10)
    r = F.exp(-S.age_days(F.col("created_at_ts"), now) / S.stability(F.col("recall_count"), d))
    return found.withColumn("retention", r).where(F.col("retention") < below).orderBy("retention", "seq").limit(limit)


def superseded(verdicts: DataFrame, signature: str, order: list[Column]) -> DataFrame:
    """All but the best verdict per signature."""
    best = latest_rows(verdicts, [signature], *order)
    return verdicts.join(best.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")


def clean_facts(facts: DataFrame, subjects: tuple[str, ...], objects: tuple[str, ...]) -> DataFrame:
    return facts.where(~is_garbage_fact(F.col("subject"), F.col("object"), F.col("confidence"), subjects, objects))


def stale_embeddings(rows: DataFrame, model: str, version: int) -> DataFrame:
    """Rows without a vector or with one of another model or version."""
    return rows.where(F.col("vector").isNull() | ~F.col("model").eqNullSafe(model) | ~F.col("version").eqNullSafe(version))


def penalised(memories: DataFrame, fails: DataFrame, factor: float = 0.85, floor: float = 0.05, words: int = 6) -> DataFrame:
    """Importance after failures: a failure of the same session, else one that shares ``words`` words,
    lowers it by ``factor``."""
    sessions = fails.select("session_id").where("session_id IS NOT NULL").distinct()
    same = memories.join(sessions, "session_id", "left_semi").select("id")
    rest = memories.join(same, "id", "left_anti")
    sets = lambda df, key: df.select(F.col(key).alias("id"), F.array_distinct(F.filter(F.split(F.lower("content"), "[ \\t\\n]+"), lambda w: w != "")).alias("tokens"))
    shared = sharing(sets(rest, "id"), sets(fails, "fail_id"), words)
    hit = same.union(shared).select("id", F.lit(True).alias("_hit"))
    out = memories.join(hit, "id", "left")
    return out.withColumn("importance", F.when(F.col("_hit"), F.greatest(F.lit(floor), F.col("importance") * factor)).otherwise(F.col("importance"))).drop("_hit")


def correction_pairs(negatives: DataFrame, positives: DataFrame) -> DataFrame:
    """The k-th failure of a session with its k-th success."""
    from pyspark.sql.window import Window

    nth = lambda df, name: df.where("session_id IS NOT NULL").select("session_id", F.col("id").alias(name), F.row_number().over(Window.partitionBy("session_id").orderBy("id")).alias("k"))
    return nth(negatives, "failed").join(nth(positives, "corrected"), ["session_id", "k"])


def sft_pairs(turns: DataFrame, least: int = 20) -> DataFrame:
    """(conv_id, turn, prompt, response): a user turn and the assistant's next, both long enough and different."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.select("conv_id", "turn", "role", F.col("text").alias("prompt"), F.lead("role").over(w).alias("_r"), F.lead("text").over(w).alias("response"))
    good = (F.col("role") == "user") & (F.col("_r") == "assistant") & (F.length("prompt") >= least) & (F.length("response") >= least) & (F.col("prompt") != F.col("response"))
    return pairs.where(good).select("conv_id", "turn", "prompt", "response")


def dpo_pairs(corrections: DataFrame, texts: DataFrame, least: int = 20) -> DataFrame:
    """(session_id, rejected, chosen) from corrections, without short or equal texts."""
    side = lambda name: texts.select(F.col("id").alias(f"_{name}"), F.col("content").alias(name))
    both = corrections.join(side("rejected"), F.col("failed") == F.col("_rejected")).join(side("chosen"), F.col("corrected") == F.col("_chosen"))
    return both.where((F.length("rejected") >= least) & (F.length("chosen") >= least) & (F.col("rejected") != F.col("chosen"))).select("session_id", "k", "rejected", "chosen")
