"""Adapters that read the driver's tables as the engine's data model.

``documents`` play findings, ``embeddings`` the vector store, ``events`` the audit and action log,
``conversations`` sessions, ``orders`` with ``lineitem`` a property graph. Derived columns are pure
arithmetic on ids, so the same view can be written in SQL: FINDINGS_SQL is that view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.storage import read_table

#: Epoch second of finding 0, step between findings, and the moment at which ages are taken.
EPOCH, STEP, NOW = 1_750_000_000, 600, 1_760_000_000
TYPES = ("observed", "inferred", "assumed", "gap")
CONFIDENCES = ("low", "medium", "high")

FINDINGS_SQL = f"""findings AS (
  SELECT doc_id AS seq, 'f' || doc_id AS id, source AS investigation_id, text, lang,
    ['observed', 'inferred', 'assumed', 'gap'][1 + doc_id % 4] AS record_type,
    ['low', 'medium', 'high'][1 + doc_id % 3] AS confidence,
    {EPOCH} + doc_id * {STEP} AS created_at_ts, 'agent' || (doc_id % 5) AS authored_by,
    CASE WHEN doc_id % 10 = 0 THEN 'cold' WHEN doc_id % 10 < 3 THEN 'hot' ELSE 'warm' END AS tier,
    CASE WHEN doc_id % 6 = 0 THEN {EPOCH} + doc_id * {STEP} + 86400 * (doc_id % 9) END AS valid_until,
    CASE WHEN doc_id % 5 <> 0 THEN 'f' || (doc_id - 1 - doc_id % 3) END AS derived_from,
    CAST(doc_id % 20 + 1 AS DOUBLE) / CAST(20 AS DOUBLE) AS importance, doc_id % 12 AS recall_count
  FROM documents)"""


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as findings; see FINDINGS_SQL for every column."""
    i = F.col("doc_id")
    born = F.lit(EPOCH) + i * STEP
    tag = lambda c: F.concat(F.lit("f"), c.cast("string"))
    return read_table(spark, sf_dir, "documents").select(
        i.alias("seq"), tag(i).alias("id"), F.col("source").alias("investigation_id"), "text", "lang",
        _pick(TYPES, i % 4).alias("record_type"), _pick(CONFIDENCES, i % 3).alias("confidence"),
        born.alias("created_at_ts"), F.concat(F.lit("agent"), (i % 5).cast("string")).alias("authored_by"),
        F.when(i % 10 == 0, "cold").when(i % 10 < 3, "hot").otherwise("warm").alias("tier"),
        F.when(i % 6 == 0, born + 86400 * (i % 9)).alias("valid_until"),
        F.when(i % 5 != 0, tag(i - 1 - i % 3)).alias("derived_from"),
        ((i % 20 + 1).cast("double") / F.lit(20.0)).alias("importance"), (i % 12).alias("recall_count"),
    )


def resolution_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` as an append log of resolutions: two entries a finding, the later one by quality."""
    rows = read_table(spark, sf_dir, "labels").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("finding_id"), "doc_id", "quality", "toxic")
    first = rows.select("finding_id", (F.col("doc_id") * 2).alias("seq"), F.lit("open").alias("resolution"))
    second = rows.select("finding_id", (F.col("doc_id") * 2 + 1).alias("seq"), F.when(F.col("quality") == 0, "wontfix").when(F.col("toxic") == 1, "unknown").otherwise("fixed").alias("resolution"))
    return first.unionByName(second)


RESOLUTIONS_SQL = """resolution_log AS (
  SELECT 'f' || doc_id AS finding_id, doc_id * 2 AS seq, 'open' AS resolution FROM labels UNION ALL
  SELECT 'f' || doc_id, doc_id * 2 + 1, CASE WHEN quality = 0 THEN 'wontfix' WHEN toxic = 1 THEN 'unknown' ELSE 'fixed' END FROM labels)"""


def retraction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` as an append log of retractions: toxic findings are retracted, every third is restored later."""
    rows = read_table(spark, sf_dir, "labels").where("toxic = 1").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("finding_id"), "doc_id")
    back = rows.where("doc_id % 3 = 0").select("finding_id", (F.col("doc_id") * 2 + 1).alias("seq"), F.lit(False).alias("active"))
    return rows.select("finding_id", (F.col("doc_id") * 2).alias("seq"), F.lit(True).alias("active")).unionByName(back)


RETRACTIONS_SQL = """retraction_log AS (
  SELECT 'f' || doc_id AS finding_id, doc_id * 2 AS seq, TRUE AS active FROM labels WHERE toxic = 1 UNION ALL
  SELECT 'f' || doc_id, doc_id * 2 + 1, FALSE FROM labels WHERE toxic = 1 AND doc_id % 3 = 0)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` as claims (item_id, text)."""
    return read_table(spark, sf_dir, "benchmark").select("item_id", "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` with the vector in double precision."""
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("long").alias("label"))


VECTORS_SQL = "vectors AS (SELECT vec_id, embedding::DOUBLE[] AS vec, label::BIGINT AS label FROM embeddings)"


def refers_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as REFERENCES edges: order (finding) to part (code symbol), once each."""
    return read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding"), F.col("l_partkey").alias("symbol")).distinct()
