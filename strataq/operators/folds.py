"""Folds of append logs into current or as-of state, lifecycle, access and bookkeeping updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataq.functions import scoring, text

RESOLUTIONS = ("open", "fixed", "intentional", "wontfix", "superseded")
FINDING_TYPES = ("observed", "inferred", "assumed", "gap", "procedure")
CONFIDENCE_ORDER = ("low", "medium", "high")
TIERS = ("hot", "warm", "cold")


def validation_error(finding_type: Column, confidence: Column, tier: Column, resolution: Column) -> Column:
    """The name of the first argument whose value is not allowed, or null."""
    return (
        F.when(~F.coalesce(finding_type.isin(*FINDING_TYPES), F.lit(False)), "finding_type").when(~F.coalesce(confidence.isin(*CONFIDENCE_ORDER), F.lit(False)), "confidence")
        .when(~F.coalesce(tier.isin(*TIERS), F.lit(False)), "tier").when(~F.coalesce(resolution.isin(*RESOLUTIONS), F.lit(False)), "resolution")
    )


def numeric_confidence(label: Column, given: Column | None = None) -> Column:
    """A given number clamped to [0, 1], else high .9, medium .6, low .3, others .6."""
    known = scoring.by_value(label, {"high": 0.9, "medium": 0.6, "low": 0.3}, 0.6)
    return known if given is None else F.coalesce(F.least(F.greatest(given.try_cast("double"), F.lit(0.0)), F.lit(1.0)), known)


def confidence_at_least(label: Column, floor: str) -> Column:
    """Whether a label reaches ``floor``; a missing one counts as low, an unknown one as below all."""
    return scoring.rank_of(F.lower(F.coalesce(label, F.lit("low"))), CONFIDENCE_ORDER) >= CONFIDENCE_ORDER.index(floor)


def latest(log: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last value per key of an append log; aggregated before the shuffle."""
    return log.groupBy(key).agg(F.max_by(value, order).alias(value))


def latest_rows(log: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first whole row per key by ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return log.withColumn("_place", place).where("_place = 1").drop("_place")


def resolution_overrides(log: DataFrame) -> DataFrame:
    """(finding_id, override): last write wins among valid states; other entries are passed over."""
    return latest(log.where(F.lower("resolution").isin(*RESOLUTIONS)), "finding_id", "seq", "resolution").withColumnRenamed("resolution", "override")


def retracted_ids(log: DataFrame) -> DataFrame:
    """finding_ids whose last entry is active; a missing flag counts as active."""
    folded = latest(log.where("finding_id IS NOT NULL").withColumn("active", F.coalesce("active", F.lit(True))), "finding_id", "seq", "active")
    return folded.where("active").select("finding_id")


def with_lifecycle(found: DataFrame, overrides: DataFrame, stored: str | None = None) -> DataFrame:
    """Adds ``resolution``: the override, else the stored state, else open."""
    own = F.col(stored) if stored else F.lit(None).cast("string")
    joined = found.join(overrides, found["id"] == overrides["finding_id"], "left")
    return joined.withColumn("resolution", F.coalesce("override", own, F.lit("open"))).drop("finding_id", "override")


def staleness(refs: DataFrame, current: DataFrame) -> DataFrame:
    """(id, stale) from (id, path, hash) and the files' (path, hash) now: true if one changed, false if
    none did, null if none could be checked."""
    now = current.select("path", F.col("hash").alias("now"))
    return refs.where("path IS NOT NULL AND hash IS NOT NULL").join(now, "path", "left").groupBy("id").agg(F.max(F.col("hash") != F.col("now")).alias("stale"))


def without_retracted(found: DataFrame, retracted: DataFrame) -> DataFrame:
    """Drops retracted findings and those that repeat the text of one in the same investigation."""
    gone = found.join(retracted, found["id"] == retracted["finding_id"], "left_semi")
    texts = gone.select(F.col("investigation_id").alias("_inv"), F.trim("text").alias("_text")).where("_text <> ''").distinct()
    left = found.join(retracted, found["id"] == retracted["finding_id"], "left_anti")
    return left.join(texts, (F.col("investigation_id") == F.col("_inv")) & (F.trim("text") == F.col("_text")), "left_anti")


def as_of(found: DataFrame, at: int) -> DataFrame:
    """Findings known and valid at an epoch second; a missing time passes."""
    born = F.coalesce(F.col("created_at_ts") <= at, F.lit(True))
    valid = F.coalesce(F.col("valid_until") >= at, F.lit(True))
    return found.where(born & valid)


def visible_to(found: DataFrame, agent: str, acl: tuple[str, ...]) -> DataFrame:
    """Rows by ``agent`` or by members of the list; an empty list or agent lets all pass."""
    return found.where((F.col("authored_by") == agent) | F.col("authored_by").isin(*acl)) if agent and acl else found


def last_n(found: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows per key in log order; Spark limits groups before the shuffle."""
    return found.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_place") <= n).drop("_place")


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of sorted rows; a limit of 0 or less gives all from the offset on."""
    out = rows.orderBy(*order).offset(offset)
    return out.limit(limit) if limit > 0 else out


def with_field(rows: DataFrame, ids: DataFrame, key: str, field: str, value: Column) -> DataFrame:
    """Rows whose key is in ``ids`` get ``value`` in ``field``; the rest stay."""
    marks = ids.select(F.col(key).alias("_key"), F.lit(True).alias("_hit")).distinct()
    joined = rows.join(marks, rows[key] == marks["_key"], "left")
    return joined.withColumn(field, F.when(F.col("_hit"), value).otherwise(F.col(field))).drop("_key", "_hit")


def shared_with(acl: Column, agents: list[str]) -> Column:
    return F.array_union(F.coalesce(acl, F.array().cast("array<string>")), F.array(*map(F.lit, agents)))


def unshared_from(acl: Column, agents: list[str]) -> Column:
    return F.array_except(F.coalesce(acl, F.array().cast("array<string>")), F.array(*map(F.lit, agents)))


def unknown_parents(found: DataFrame) -> DataFrame:
    """(id, derived_from) of findings that name a parent which does not exist."""
    return found.where("derived_from IS NOT NULL").select("id", "derived_from").join(found.select(F.col("id").alias("_id")), F.col("derived_from") == F.col("_id"), "left_anti")


def open_obligations(log: DataFrame) -> DataFrame:
    """Latest record per obligation that is still open."""
    return latest_rows(log, ["obligation_id"], F.desc("seq")).where("status = 'open'")


def attempt_counters(attempts: DataFrame) -> DataFrame:
    """(procedure_id, attempts, successes, success_rate) with the rate to four places."""
    n, good = F.count("*"), F.sum(F.col("success").cast("long"))
    return attempts.groupBy("procedure_id").agg(n.alias("attempts"), good.alias("successes"), F.round(good / n, 4).alias("success_rate"))


def without_noise(items: DataFrame, order: str, *meta: str) -> DataFrame:
    """Drops blank texts, dump-marked and dump-like rows and later rows with the same first 200 squeezed characters."""
    marks = "pre_compress|session_end|session_dump|conversation|transcript|turn"
    clean = items.where(F.trim("text") != "").where(~F.lower(F.concat_ws(" ", *meta)).rlike(marks) if meta else F.lit(True)).where(~text.looks_like_dump(F.col("text")))
    return latest_rows(clean.withColumn("_key", F.sha2(F.substring(text.squeeze(F.col("text")), 1, 200), 256)), ["_key"], F.asc(order)).drop("_key")


def hints(rows: DataFrame, limit: int, since: int, now: int) -> DataFrame:
    """The newest rows since a moment with their recency 1 / (1 + age in hours)."""
    out = rows.where(F.col("created_at_ts") > since).orderBy(F.desc("created_at_ts"), F.desc("seq")).limit(limit)
    return out.withColumn("recency", scoring.hint_recency(scoring.age_days(F.col("created_at_ts"), now) * 24))


def is_garbage_fact(subject: Column, obj: Column, confidence: Column, subjects: tuple[str, ...], objects: tuple[str, ...]) -> Column:
    short = (F.length(subject) < 4) & (confidence > 0) & (confidence < 0.5)
    return F.coalesce(F.trim(subject).isin(*subjects), F.lit(False)) | F.coalesce(F.lower(F.trim(obj)).isin(*objects), F.lit(False)) | F.coalesce(short, F.lit(False))


def failures(rows: DataFrame, least: float, since: int, limit: int) -> DataFrame:
    """The newest important rows since a moment that speak of a failure."""
    return rows.where(F.col("text").rlike("FAILURE|FAILED|ERROR|REPEATED") & (F.col("importance") >= least) & (F.col("created_at_ts") > since)).orderBy(F.desc("created_at_ts"), F.desc("seq")).limit(limit)
