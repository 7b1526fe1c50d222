"""Queries on stateful operators, in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.queries.base import query
from strataq.storage import read_table
from strataq.streaming import state as S

_NOW = 1_706_745_600  # 2024-02-01


def _deposits(spark, sf):
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return read_table(spark, sf, "events").select(F.col("event_type").alias("topic"), ts.alias("ts"), (F.col("value") / 100).alias("amount"), (F.col("event_id") % 500 == 0).alias("reset"))


_DEPOSITS = "d AS (SELECT event_type AS topic, epoch_us(ts) / 1000000::DOUBLE AS ts, value / 100 AS amount, event_id % 500 = 0 AS reset FROM events)"


@query("quorum_level", f"WITH {_DEPOSITS}, c AS (SELECT topic, max(ts) AS since FROM d WHERE reset GROUP BY 1) SELECT topic, round(sum(amount * exp(-ln(2::DOUBLE) / 604800 * greatest({_NOW} - ts, 0))), 6) AS level FROM d LEFT JOIN c USING (topic) WHERE NOT reset AND (since IS NULL OR ts > since) GROUP BY 1")
def quorum_level(spark, sf):
    return S.quorum_levels(_deposits(spark, sf), _NOW, 604_800.0).select("topic", F.round("level", 6).alias("level"))


@query("quorum_reached", f"WITH {_DEPOSITS}, c AS (SELECT topic, max(ts) AS since FROM d WHERE reset GROUP BY 1), l AS (SELECT topic, sum(amount * exp(-ln(2::DOUBLE) / 604800 * greatest({_NOW} - ts, 0))) AS level FROM d LEFT JOIN c USING (topic) WHERE NOT reset AND (since IS NULL OR ts > since) GROUP BY 1) SELECT topic, level >= 5 AS reached FROM l WHERE level >= 0.01")
def quorum_reached(spark, sf):
    return S.quorum_reached(S.quorum_levels(_deposits(spark, sf), _NOW, 604_800.0), 5.0).select("topic", "reached")


@query("saturation_filter", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n <= 3")
def saturation_filter(spark, sf):
    e = read_table(spark, sf, "events").withColumn("signature", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    return S.unsaturated(e, "signature", "event_id").select("event_id")


@query("promoted_verdicts", "WITH v AS (SELECT user_id AS query, 0.9 + (event_id % 10) / 100.0 AS similarity, CASE WHEN event_type = 'error' THEN 'block' ELSE 'allow' END AS decision, value / 40 AS confidence, event_id % 4 AS occurrences, event_id AS verdict FROM events), g AS (SELECT * FROM v WHERE similarity::DOUBLE >= 0.92 AND decision = 'block' AND confidence >= 0.75) SELECT query, greatest(count(*), max(occurrences)) AS occurrences, arg_max(verdict, (similarity, verdict)) AS verdict FROM g GROUP BY 1 HAVING greatest(count(*), max(occurrences)) >= 3")
def promoted_verdicts(spark, sf):
    v = read_table(spark, sf, "events").select(F.col("user_id").alias("query"), ((F.col("event_id") % 10 + 90) / F.lit(100.0)).alias("similarity"), F.when(F.col("event_type") == "error", "block").otherwise("allow").alias("decision"), (F.col("value") / 40).alias("confidence"), (F.col("event_id") % 4).alias("occurrences"), F.col("event_id").alias("verdict"))
    return S.promoted(v)


@query(
    "provisional_verdicts",
    """WITH l AS (SELECT user_id AS signature, event_id AS seq, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 4 ELSE 3 END AS severity FROM events),
    p AS (SELECT *, lag(severity) OVER w AS prior FROM l WINDOW w AS (PARTITION BY signature ORDER BY seq)), r AS (SELECT *, sum((prior IS NULL OR prior <> severity)::INT) OVER (PARTITION BY signature ORDER BY seq) AS run FROM p),
    h AS (SELECT *, row_number() OVER (PARTITION BY signature, run ORDER BY seq) AS held FROM r), c AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY signature ORDER BY seq), 0) AS prior_count FROM h)
    SELECT seq, prior_count, coalesce(prior <> severity AND abs(severity - prior) / 3.0 >= 0.5 AND prior_count >= 3, FALSE) AS provisional FROM c""",
)
def provisional_verdicts(spark, sf):
    severity = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "error", 4).otherwise(3)
    log = read_table(spark, sf, "events").select(F.col("user_id").alias("signature"), F.col("event_id").alias("seq"), severity.alias("severity"))
    return S.provisional_verdicts(log).select("seq", "prior_count", "provisional")


@query("priming", "WITH e AS (SELECT user_id::VARCHAR AS topic, value AS delta, event_id AS ts, event_id + (event_id % 7) * 2000 AS expires_at FROM events) SELECT topic, arg_max(delta, ts) AS delta FROM e WHERE expires_at > 9000 GROUP BY 1")
def priming(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("user_id").cast("string").alias("topic"), F.col("value").alias("delta"), F.col("event_id").alias("ts"), (F.col("event_id") + F.col("event_id") % 7 * 2000).alias("expires_at"))
    return S.primed(e, 9000)


@query("sync_since", "SELECT event_id FROM events WHERE strftime(ts, '%Y-%m-%dT%H:%M:%S') > '2024-01-15T00:00:00' AND event_id % 10 <> 0")
def sync_since(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))
    return S.new_since(e, "2024-01-15 00:00:00", e.where("event_id % 10 = 0"), "event_id", "at").select("event_id")
