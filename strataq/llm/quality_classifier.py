"""Document quality by regularised quadratic discriminant analysis, planned as DataFrame operations.

Every text becomes a few transformed statistics (logs and log odds, so that classes are nearer to
normal). Each class has its mean and a covariance shrunk towards the pooled covariance and that
towards a multiple of the identity. Sufficient statistics are summed over all labelled rows in one
aggregation; the driver gets two rows, caches each class's inverse Cholesky factor, and scores are
differences of Mahalanobis log densities, evaluated as Column arithmetic. Texts of any length are
counted whole; their words and lines are arrays of one row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import textstats as S
from strataq.storage import materialize, read_table

FEATURES = ("words", "word_length", "distinct", "symbols", "punctuation", "digits", "upper", "repeated_lines", "line_words", "other_bytes")


def statistics(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """The columns of ``keep`` as struct ``_row`` and one double per name in FEATURES, never null; null counts as empty."""
    t = S.whole(F.col("text"))
    base = docs.select(F.struct(*keep).alias("_row"), t.alias("_t"), S.words_of(F.col("text")).alias("_w"), S.lines_of(F.col("text")).alias("_l"))
    t, w, lines = F.col("_t"), F.col("_w"), F.col("_l")
    counts = {
        "n": F.size(w), "chars": F.length(t), "word_chars": F.length(F.array_join(w, "")), "distinct": F.size(F.array_distinct(w)),
        "symbols": S.count_of(t, S.SYMBOLS), "punct": S.count_of(t, S.PUNCTUATION), "digits": S.count_of(t, S.DIGITS), "upper": S.count_of(t, S.UPPER),
        "lines": F.size(lines), "dup": F.size(lines) - F.size(F.array_distinct(lines)), "bytes": F.octet_length(t),
    }
    names = [f"_{k}" for k in counts]
    n = base.select("_row", *(c.cast("double").alias(k) for k, c in zip(names, counts.values())))
    c = {k: F.col(f"_{k}") for k in counts}
    odds = lambda part, all_: F.log((part + 0.5) / (all_ - part + 0.5))
    values = {
        "words": F.log(c["n"] + 1), "word_length": F.log((c["word_chars"] + 1) / (c["n"] + 1)), "distinct": odds(c["distinct"], c["n"]),
        "symbols": odds(c["symbols"], c["chars"]), "punctuation": odds(c["punct"], c["chars"]), "digits": odds(c["digits"], c["chars"]), "upper": odds(c["upper"], c["chars"]),
        "repeated_lines": odds(c["dup"], c["lines"]), "line_words": F.log((c["n"] + 1) / (c["lines"] + 1)), "other_bytes": odds(c["bytes"] - c["chars"], c["bytes"]),
    }
    return n.select("_row", *(v.alias(k) for k, v in values.items()))


@dataclass(frozen=True)
class Discriminant:
    """Means and inverse Cholesky factors of both classes; ``fixed`` replaces them where a class is missing."""

    means: tuple[np.ndarray, np.ndarray] | None
    factors: tuple[np.ndarray, np.ndarray] | None
    offset: float
    fixed: float | None = None

    @staticmethod
    def fit(rows: dict[int, tuple[int, np.ndarray, np.ndarray]], to_pooled: float, to_identity: float) -> Discriminant:
        """``rows``: by class its count, sum vector and sum of outer products."""
        if 0 not in rows:
            return Discriminant(None, None, 0.0, 1.0)
        if 1 not in rows:
            return Discriminant(None, None, 0.0, 0.0)
        mean = {k: s / n for k, (n, s, _) in rows.items()}
        scatter = {k: q - rows[k][0] * np.outer(mean[k], mean[k]) for k, (_, _, q) in rows.items()}
        total = sum(n for n, _, _ in rows.values())
        pooled = (scatter[0] + scatter[1]) / max(1, total - 2)
        pooled = (1 - to_identity) * pooled + to_identity * max(np.trace(pooled) / len(pooled), 1e-6) * np.eye(len(pooled))
        factors, logdet = [], []
        for k in (0, 1):
            own = scatter[k] / max(1, rows[k][0] - 1)
            lower = np.linalg.cholesky((1 - to_pooled) * own + to_pooled * pooled)
            factors.append(np.linalg.inv(lower))
            logdet.append(2 * float(np.log(np.diag(lower)).sum()))
        offset = 0.5 * (logdet[0] - logdet[1]) + math.log(rows[1][0] / rows[0][0])
        return Discriminant((mean[0], mean[1]), (factors[0], factors[1]), offset)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """The same in numpy, for tests: rows of statistics to log odds of class 1."""
        d = [((x - m) @ f.T) ** 2 for m, f in zip(self.means, self.factors)]
        return 0.5 * (d[0].sum(1) - d[1].sum(1)) + self.offset

    def score(self) -> Column:
        if self.fixed is not None:
            return F.lit(self.fixed)
        distance = []
        for m, f in zip(self.means, self.factors):
            parts = []
            for i in range(len(m)):
                z = sum((F.lit(float(f[i, j])) * (F.col(FEATURES[j]) - float(m[j])) for j in range(1, i + 1)), F.lit(float(f[i, 0])) * (F.col(FEATURES[0]) - float(m[0])))
                parts.append(z * z)
            distance.append(sum(parts[1:], parts[0]))
        odds = (distance[0] - distance[1]) * 0.5 + self.offset
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(odds, F.lit(-700.0)), F.lit(700.0))))


def fit(stats: DataFrame, labels: DataFrame, to_pooled: float = 0.2, to_identity: float = 0.01) -> Discriminant:
    """Fit on all rows of ``labels`` (doc_id, quality 0 or 1) that ``stats`` holds; other label values are ignored."""
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_q"))
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
    sums = [F.sum(F.col(f)) for f in FEATURES] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in pairs]
    rows = {}
    for r in stats.join(known, stats["_row.doc_id"] == known["doc_id"]).groupBy("_q").agg(F.count("*"), *sums).collect():
        outer = np.zeros((len(FEATURES), len(FEATURES)))
        for (i, j), v in zip(pairs, r[2 + len(FEATURES) :]):
            outer[i, j] = outer[j, i] = v
        rows[r[0]] = (r[1], np.array(r[2 : 2 + len(FEATURES)], float), outer)
    return Discriminant.fit(rows, to_pooled, to_identity)


def in_fold(doc_id: Column, parts: int, fold: int) -> Column:
    """Whether crc32 of the id as text, modulo ``parts``, is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == fold, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, keep: list[Column], threshold: float = 0.7) -> DataFrame:
    """The columns of ``keep``, held_out, score and predicted for every row of ``docs``.

    Labels count only outside the held-out fold (crc32 of doc_id, mod 4 = 2). The score depends on
    the text alone; equal texts have equal scores. Without labels of class 0 every score is 1, with
    none but class 0 it is 0. ``keep`` has to hold doc_id; a kept column named like a result gives
    way to it. Empty tables give no rows.
    """
    stats = materialize(statistics(docs, keep), "quality-statistics")
    model = fit(stats, labels.where(~in_fold(F.col("doc_id"), 4, 2)))
    held_out, score = in_fold(F.col("_row.doc_id"), 4, 2).alias("held_out"), model.score()
    return S.unpacked(stats, held_out, score.alias("score"), (score >= threshold).cast("int").alias("predicted"), names=("held_out", "score", "predicted"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return score_quality(docs, labels, [F.col("doc_id").cast("long").alias("doc_id")])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts as class 1, with all their columns.

    Statistics are computed once to fit and once beside the rows, which is cheaper than to move texts.
    """
    model = fit(materialize(statistics(docs, [F.col("doc_id").cast("long").alias("doc_id")]), "quality-statistics"), labels.where(~in_fold(F.col("doc_id"), 4, 2)))
    return S.unpacked(statistics(docs, [F.col(f"`{c}`") for c in docs.columns]).where(model.score() >= 0.7))
