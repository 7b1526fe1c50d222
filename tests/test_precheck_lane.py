"""The semantic lane of the precheck has a threshold and no k."""

import pytest

from strataq.queries import registry


def test_more_than_a_thousand_near_vectors_all_match(spark, tmp_path):
    rows = [(i, [1.0, i * 1e-5], 0) for i in range(1100)] + [(1100 + i, [-1.0, 0.1], 0) for i in range(5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    out = registry.QUERIES["evidence_precheck"](spark, f"file://{tmp_path}", lexical=False).where("query = 0").collect()
    assert {r["id"] for r in out} >= set(range(1, 1100)) and all(r["id"] < 1100 for r in out if r["lane"] == "semantic")
    with pytest.raises(Exception, match="(?i)exist|not find"):
        registry.QUERIES["evidence_precheck"](spark, f"file://{tmp_path}")
