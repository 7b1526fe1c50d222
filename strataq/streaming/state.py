"""Decaying accumulators, promotion and saturation: closed forms for batches, processors for streams.

A deposit a at time t is worth a * 2 ** (-(now - t) / half_life) later, so the value of sequential
updates since the last reset is a plain sum, which Spark aggregates before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataq.functions.scoring import half_life

HALF_LIFE = 1800.0


def quorum_levels(deposits: DataFrame, now: float, length: float = HALF_LIFE) -> DataFrame:
    """(topic, level) at ``now`` of (topic, ts, amount, reset): the decayed sum of deposits since the last reset."""
    cleared = deposits.where("reset").groupBy("topic").agg(F.max("ts").alias("_since"))
    live = deposits.where("NOT reset").join(cleared, "topic", "left").where("_since IS NULL OR ts > _since")
    age = F.greatest(F.lit(float(now)) - F.col("ts"), F.lit(0.0))
    return live.groupBy("topic").agg(F.sum(F.col("amount") * half_life(age, length)).alias("level"))


def quorum_reached(levels: DataFrame, threshold: float, floor: float = 0.01) -> DataFrame:
    """Adds ``reached``; topics that have faded below ``floor`` drop out."""
    return levels.where(F.col("level") >= floor).withColumn("reached", F.col("level") >= threshold)


def promoted(verdicts: DataFrame, least_confidence: float = 0.75, similarity: float = 0.92, after: int = 3) -> DataFrame:
    """(query, occurrences, verdict) of recalled verdicts (query, similarity, decision, confidence, occurrences,
    verdict): blocking ones that are close and sure enough promote once they, or the most frequent of
    them, count ``after``."""
    good = verdicts.where((F.col("similarity") >= similarity) & F.col("decision").isin("block", "flag") & (F.col("confidence") >= least_confidence))
    per = good.groupBy("query").agg(F.greatest(F.count("*"), F.max("occurrences")).alias("occurrences"), F.max_by("verdict", F.struct("similarity", "verdict")).alias("verdict"))
    return per.where(F.col("occurrences") >= after)


def unsaturated(log: DataFrame, signature: str, order: str, most: int = 3) -> DataFrame:
    """The first ``most`` observations per signature; later ones are suppressed."""
    place = F.row_number().over(Window.partitionBy(signature).orderBy(order))
    return log.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def provisional_verdicts(log: DataFrame, threshold: float = 0.5, least: int = 3) -> DataFrame:
    """Adds the prior severity, how often it stood unchanged, and ``provisional``: the change is large and
    the prior was established. The log is (signature, seq, severity)."""
    w = Window.partitionBy("signature").orderBy("seq")
    prior = F.lag("severity").over(w)
    run = log.withColumn("prior", prior).withColumn("_new", (F.col("prior").isNull() | (F.col("prior") != F.col("severity"))).cast("int"))
    run = run.withColumn("_run", F.sum("_new").over(w)).withColumn("_held", F.row_number().over(Window.partitionBy("signature", "_run").orderBy("seq")))
    run = run.withColumn("prior_count", F.coalesce(F.lag("_held").over(w), F.lit(0)))
    error = F.abs(F.col("severity") - F.col("prior")) / 3.0
    flag = F.coalesce((F.col("prior") != F.col("severity")) & (error >= threshold) & (F.col("prior_count") >= least), F.lit(False))
    return run.withColumn("provisional", flag).drop("_new", "_run", "_held")


def primed(entries: DataFrame, now: float) -> DataFrame:
    """(topic, delta): the newest entry per topic that has not expired."""
    return entries.where(F.col("expires_at") > now).groupBy("topic").agg(F.max_by("delta", "ts").alias("delta"))


def new_since(rows: DataFrame, since: str | None, delivered: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows after a watermark that were not delivered yet; timestamps are compared with T as their separator."""
    at = F.replace(F.col(ts), F.lit(" "), F.lit("T"))
    fresh = rows.where(at > F.lit(since.replace(" ", "T"))) if since else rows
    return fresh.join(delivered.select(key), key, "left_anti")


def stream_quorum(deposits: DataFrame, length: float = HALF_LIFE) -> DataFrame:
    """(topic, ts, level) after each deposit of a stream (topic, ts, amount): one value and time per topic is
    kept, in event order within a batch; older deposits that come late count with the decay they have had."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    rate = math.log(2) / length

    def update(key: tuple, batches: Iterator, state: GroupState):
        import pandas as pd

        value, at = state.get if state.exists else (0.0, None)
        out = []
        for r in pd.concat(list(batches)).sort_values("ts").itertuples():
            if at is None or r.ts >= at:
                value = value * math.exp(-rate * (r.ts - at)) + r.amount if at is not None else float(r.amount)
                at = float(r.ts)
            else:
                value += r.amount * math.exp(-rate * (at - r.ts))
            out.append((key[0], at, value))
        state.update((value, at))
        yield pd.DataFrame(out, columns=["topic", "ts", "level"])

    return deposits.groupBy("topic").applyInPandasWithState(update, "topic string, ts double, level double", "value double, at double", "append", GroupStateTimeout.NoTimeout)


def stream_counts(events: DataFrame, ts: str, key: str, window: str, late: str) -> DataFrame:
    """Counts per tumbling window of a stream, with late events dropped after ``late``; ours, for dashboards."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def stream_once(rows: DataFrame, key: str, ts: str, horizon: str) -> DataFrame:
    """Each id once within a horizon, so that a resent row is not delivered twice."""
    return rows.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key])


def reflect(spark, source: str, schema: str, sink: str, checkpoint: str, files: int = 3, most: int = 3):
    """A stream of log lines (source, line, seq), ``files`` new files a tick: each tick appends its counts of
    (severity, signature), without signatures that were seen ``most`` times before."""
    from pyspark.sql.utils import AnalysisException

    from strataq.functions.text import canonical_signature, line_severity

    def tick(batch: DataFrame, number: int) -> None:
        seen = batch.select(line_severity(F.col("line")).alias("severity"), canonical_signature(F.col("line")).alias("signature")).where("severity IS NOT NULL")
        counts = seen.groupBy("severity", "signature").agg(F.count("*").alias("n"))
        try:
            old = spark.read.parquet(sink).where(F.col("tick") != number).groupBy("signature").agg(F.sum("n").alias("_n")).where(F.col("_n") >= most)
            counts = counts.join(old, "signature", "left_anti")
        except AnalysisException:
            pass  # the first tick has no sink to read
        counts.withColumn("tick", F.lit(number)).write.mode("append").parquet(sink)

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(source)
    return rows.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
