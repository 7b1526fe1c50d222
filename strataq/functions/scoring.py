"""Similarity, decay and ranking scores as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY, HOUR = 86400.0, 3600.0


def by_value(value: Column, scores: dict[str, float], default: float) -> Column:
    out = None
    for k, v in scores.items():
        out = F.when(F.lower(value) == k, v) if out is None else out.when(F.lower(value) == k, v)
    return out.otherwise(default)


def rank_of(value: Column, order: tuple[str, ...]) -> Column:
    """Place of a value in ``order``, -1 for others."""
    return (F.coalesce(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)) - 1).cast("int")


def dot(a: Column, b: Column) -> Column:
    """Sum of products in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of double; 0 for empty, unequal or zero vectors."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector as it is. Its length is taken once: within the inner function it would be for every element."""
    return F.transform(F.array(F.sqrt(dot(a, a))), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x)))[0]


def _common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def claim_overlap(claim: Column, other: Column) -> Column:
    return F.when(F.size(claim) > 0, _common(claim, other) / F.size(claim)).otherwise(0.0)


def overlap_min(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, _common(a, b) / least).otherwise(0.0)


def overlap_max(a: Column, b: Column) -> Column:
    return F.when(F.least(F.size(a), F.size(b)) > 0, _common(a, b) / F.greatest(F.size(a), F.size(b))).otherwise(0.0)


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    total = F.size(F.array_union(a, b))
    return F.when(total > 0, _common(a, b) / total).otherwise(both_empty)


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / (F.greatest(F.length(a), F.length(b)) + 1)


def age_days(created: Column, now: float) -> Column:
    """Days from an epoch second to ``now``, at least 0."""
    return F.greatest((F.lit(float(now)) - created.cast("double")) / DAY, F.lit(0.0))


def parsed_age_days(text: Column, now: float) -> Column:
    """Days from a timestamp in text: 0 for an empty one, -1 where it cannot be read."""
    at = F.unix_timestamp(F.try_to_timestamp(F.trim(text))).cast("double")
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(F.coalesce((F.lit(float(now)) - at) / DAY, F.lit(-1.0)))


def exponential_decay(score: Column, created: Column, now: float, rate: float = 0.007) -> Column:
    """score * exp(-rate * age in days); an unknown age leaves the score."""
    return F.coalesce(score * F.exp(-rate * age_days(created, now)), score)


def weibull_retention(age: Column, scale: float = 30.0, shape: float = 0.8) -> Column:
    return F.when(age <= 0, 1.0).otherwise(F.exp(-F.pow(age / scale, F.lit(shape))))


def half_life(age: Column, length: float) -> Column:
    return F.exp(F.lit(-math.log(2) / length) * age)


def hint_recency(age_hours: Column) -> Column:
    return F.lit(1.0) / (1.0 + age_hours)


def stability(recalls: Column, difficulty: Column) -> Column:
    """max(1, d / 2) * (1 + recalls) ** (1 / max(1, d))."""
    return F.greatest(F.lit(1.0), difficulty * 0.5) * F.pow(F.coalesce(recalls, F.lit(0)) + 1.0, 1.0 / F.greatest(F.lit(1.0), difficulty))


def initial_difficulty(importance: Column, least: float = 1.0, most: float = 10.0) -> Column:
    return F.least(F.greatest(11.0 - F.coalesce(importance, F.lit(5.0)), F.lit(least)), F.lit(most))


def stability_after_success(s: Column, r: Column, d: Column, w1: float = 0.4, w2: float = 0.6) -> Column:
    return s * F.exp(w1 * (11.0 - d) * (F.exp(w2 * (1.0 - r)) - 1.0) + 1.0)


def stability_after_failure(s: Column, factor: float = 0.5) -> Column:
    return F.greatest(F.lit(0.5), s * factor)


def retention_grade(r: Column) -> Column:
    return F.when(r >= 0.9, 5.0).when(r >= 0.75, 4.0).when(r >= 0.55, 3.0).when(r >= 0.35, 2.0).otherwise(1.0)


def next_difficulty(d: Column, grade: Column, least: float = 1.0, most: float = 10.0) -> Column:
    return F.least(F.greatest(d + 0.15 * (4.0 - grade), F.lit(least)), F.lit(most))


TRUST = {"high": 1.0, "medium": 0.7, "low": 0.4}
TYPE_WEIGHT = {"observed": 1.0, "inferred": 0.8, "assumed": 0.6, "gap": 0.4}


def multi_signal(relevance: Column, created: Column, confidence: Column, record_type: Column, pheromone: Column, now: float, half_days: float = 7.0) -> Column:
    """.50 relevance + .20 recency + .15 trust + .15 type + .08 ln(1 + pheromone)."""
    recency = F.coalesce(half_life(age_days(created, now), half_days), F.lit(0.5))
    return 0.50 * relevance + 0.20 * recency + 0.15 * by_value(confidence, TRUST, 0.6) + 0.15 * by_value(record_type, TYPE_WEIGHT, 0.7) + 0.08 * F.log1p(pheromone)


def replay_priority(created: Column, importance: Column, confidence: Column, recalls: Column, now: float, half_hours: float = 3.0) -> Column:
    """.40 recency + .35 salience + .25 ln(1 + recalls) / ln(11)."""
    recency = F.coalesce(half_life(age_days(created, now) * 24, half_hours), F.lit(0.3))
    salience = F.least(F.lit(1.0), importance * by_value(confidence, {"high": 1.2, "medium": 1.0, "low": 0.7}, 1.0))
    return 0.40 * recency + 0.35 * salience + 0.25 * F.log1p(recalls.cast("double")) / math.log1p(10)


def keyword_boost(query_tokens: Column, content: Column) -> Column:
    """min(.25, .05 a hit) for query tokens of over three letters, if the query has two tokens or more."""
    hits = F.size(F.filter(query_tokens, lambda t: (F.length(t) > 3) & F.contains(F.lower(content), t)))
    return F.when(F.size(query_tokens) >= 2, F.least(F.lit(0.25), hits * 0.05)).otherwise(0.0)


def protection(confidence: Column, record_type: Column) -> Column:
    base = by_value(confidence, {"high": 0.9, "medium": 0.6, "low": 0.3}, 0.5)
    return F.least(F.lit(1.0), base * by_value(record_type, {"observed": 1.1, "inferred": 1.0, "assumed": 0.85, "gap": 0.7}, 1.0))


def prediction_error(new_severity: Column, old_severity: Column) -> Column:
    return F.abs(new_severity - old_severity) / 3.0


SEVERITY = {"claim_supported": 1.0, "claim_ambiguous": 2.0, "claim_unsupported": 3.0, "claim_contradicted": 4.0}


def confidence_verdict(fluency: Column, accessibility: Column, sources: Column, corroboration: Column, trust: Column) -> tuple[Column, Column, Column]:
    """Confidence, its basis and a recommendation from the five cues."""
    raw = 0.10 * fluency + 0.20 * accessibility + 0.30 * F.least(F.lit(1.0), sources / 5.0) + 0.15 * corroboration + 0.25 * trust
    confidence = 1.0 / (1.0 + F.exp(-8 * (raw - 0.5)))
    basis = F.when(sources >= 2, "recollection").when(corroboration > 0.3, "corroboration").when(trust > 0.7, "trust").otherwise("familiarity")
    advice = F.when(confidence >= 0.75, "confident").when(confidence >= 0.5, "moderate").when(confidence >= 0.3, "low").otherwise("unreliable")
    return confidence, basis, advice


def chain_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def pair_features(a: Column, b: Column, text_a: Column, text_b: Column, words_a: Column, words_b: Column) -> Column:
    """|a - b|, a * b, cosine, its square, length ratio and word overlap in one array."""
    cos = cosine(a, b)
    return F.concat(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y), F.array(cos, cos * cos, length_ratio(text_a, text_b), jaccard(words_a, words_b, 1.0)))


def critic_features(scores: Column, query: Column) -> Column:
    """[top, mean, least, spread, number, query words] of a list of retrieval scores."""
    n = F.size(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.greatest(n, F.lit(1))
    top, least = F.coalesce(F.array_max(scores), F.lit(0.0)), F.coalesce(F.array_min(scores), F.lit(0.0))
    return F.array(top, mean, least, top - least, n.cast("double"), F.size(F.filter(F.split(F.trim(query), "[ \\t\\n]+"), lambda w: w != "")).cast("double"))


def critic_accepts(features: Column, top: float = 0.5, mean: float = 0.45) -> Column:
    return (features[0] >= top) & (features[1] >= mean)
