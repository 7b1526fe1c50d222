"""Locals, types and import maps of source files, and approximate search."""

import random

import pytest
from pyspark.sql import functions as F

from strataq.functions import code
from strataq.operators import retrieval, stores

SOURCE = """
def flag(items):
    degraded = False
    n = 0
    total = 0
    for x in items:
        if not x:
            continue
        n += 1
        total = total + x
        try:
            go(x)
        except E:
            return None
        if x > 3:
            degraded = True
    return degraded

def never():
    off = False
    if a:
        return off
    def inner():
        off = True
    return off
"""


def test_flags_rank_above_counters(spark):
    rows = code.parse_python(spark.createDataFrame([("m.py", SOURCE)], "path string, content string"))
    got = {r["id"].split("::", 1)[1]: (r["assign_forms"], r["constant_rebinds"], r["guard_exits"]) for r in code.flag_bindings(rows).collect()}
    assert got == {"flag::degraded": (["constant"], 1, 2), "flag::n": (["augmented"], 0, 2), "flag::total": (["computed"], 0, 2), "never::off": ([], 0, 1), "never.inner::off": ([], 0, 0)}
    ranked = [(r["id"].split("::", 1)[1], r["pattern"], r["score"]) for r in stores.ranked_flags(code.flag_bindings(rows)).collect()]
    assert ranked == [("flag::degraded", "flag", 2.0), ("never::off", "flag", 1.0), ("never.inner::off", "flag", 0.0)]
    assert stores.ranked_flags(code.flag_bindings(rows), True).count() == 5


@pytest.mark.parametrize("given,want", [("final java.util.List<String>[]", "List"), ("Map<String, List<int[]>>", "Map"), ("string?", "string"), ("const std::vector<int>&", "vector"), ("Store | None", "Store"), ("list[dict[str, int]]", "list"), ("", None), (None, None), ("a b", None)])
def test_types_are_normalised(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(code.normalised_type(F.col("t")).alias("x")).first()["x"] == want


def test_import_maps_resolve_relative_names(spark):
    files = [("pkg/sub/m.py", "import a.b\nimport a.c as d\nfrom x import y as z, w\nfrom . import near\nfrom ..up import q\n"), ("pkg/sub/__init__.py", "from .m import k\nfrom .. import top\n")]
    got = {(r["path"].rsplit("/", 1)[1], r["local"]): r["fqn"] for r in code.import_map(code.parse_python(spark.createDataFrame(files, "path string, content string"))).collect()}
    assert got == {("m.py", "b"): "a.b", ("m.py", "d"): "a.c", ("m.py", "z"): "x.y", ("m.py", "w"): "x.w", ("m.py", "near"): "pkg.sub.near", ("m.py", "q"): "pkg.up.q", ("__init__.py", "k"): "pkg.sub.m.k", ("__init__.py", "top"): "pkg.top"}


def test_approximate_search_reaches_nine_tenths(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(25)]
    base = spark.createDataFrame([(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centres)]) for i in range(1500)], "id long, vec array<double>")
    queries = base.where("id % 50 = 0").select(F.col("id").alias("query"), "vec")
    index, points = retrieval.vector_cells(base, 32)
    assert index.count() == 1500 and len(points) == 32
    exact = retrieval.knn(queries, base, 10)
    few, all_ = (retrieval.recall_of(retrieval.approximate_knn(queries, index, points, 10, n), exact).first()[0] for n in (8, 32))
    assert few >= 0.9 and all_ == 1.0
    empty, none = retrieval.vector_cells(base.limit(0))
    assert retrieval.approximate_knn(queries, empty, none, 3, 2).count() == 0
