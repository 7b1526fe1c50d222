"""Queries on versioned tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.plans import tables as T
from strataq.plans.tables import FINDINGS_SQL
from strataq.queries.base import query
from strataq.sources.versions import VersionedTable
from strataq.storage import new_path


@query(
    "versioned_findings",
    f"""WITH {FINDINGS_SQL} SELECT 'pinned' AS state, id, confidence FROM findings WHERE seq % 2 = 0 OR seq % 5 <> 0
    UNION ALL SELECT 'latest', id, CASE WHEN seq % 3 = 0 THEN 'revised' ELSE confidence END FROM findings WHERE (seq % 2 = 0 OR seq % 5 <> 0 OR seq % 3 = 0) AND record_type <> 'gap'""",
)
def versioned_findings(spark, sf):
    """Two appends, an upsert, a deletion and a rewrite: what a reader pinned to the appends sees, and what the latest version holds."""
    f = T.findings(spark, sf).select("id", "seq", "record_type", "confidence")
    table = VersionedTable(spark, new_path(spark, "versioned-findings"), f.schema)
    table.append(f.where("seq % 2 = 0"))
    pinned = table.append(f.where("seq % 2 = 1 AND seq % 5 <> 0"))
    table.upsert(f.where("seq % 3 = 0").withColumn("confidence", F.lit("revised")), "id")
    table.delete(F.col("record_type") == "gap")
    table.rewrite()
    of = lambda state, rows: rows.select(F.lit(state).alias("state"), "id", "confidence")
    return of("pinned", table.read(pinned)).unionByName(of("latest", table.read()))
