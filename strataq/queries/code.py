"""Queries on source code: the engine's own files, read as a table."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from strataq.functions import code as C
from strataq.queries.base import query

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _files(spark):
    """The package's operators and functions, read by the driver: where executors see no local files, content travels with the plan."""
    rows = []
    for part in ("functions", "operators", "plans", "sources", "streaming"):
        for name in sorted(os.listdir(os.path.join(_ROOT, part))):
            if name.endswith(".py"):
                with open(os.path.join(_ROOT, part, name), encoding="utf-8") as f:
                    rows.append((f"strataq/{part}/{name}", f.read()))
    return spark.createDataFrame(rows, "path string, content string")


@query("code_symbols")
def code_symbols(spark, sf):
    return C.parse_python(_files(spark)).where("kind IN ('function', 'class')").select("path", "name", "line", "end_line")


@query("code_call_resolution")
def code_call_resolution(spark, sf):
    return C.resolve_python_calls(C.parse_python(_files(spark))).groupBy("rung").agg(F.count("*").alias("calls"))


@query("code_rules")
def code_rules(spark, sf):
    return C.parse_python(_files(spark)).where("kind = 'rule'").groupBy("name").agg(F.count("*").alias("n"))


@query("code_unread_names")
def code_unread_names(spark, sf):
    return C.unread_names(C.parse_python(_files(spark)))
