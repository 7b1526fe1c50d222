"""The pipeline against a brute-force version of its stages, and on tables with odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strataq.llm import pieces, quality_classifier
from test_operators_llm import LABELS, ROWS, brute_components


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Good and junk texts, exact and near copies in three sources, half of them labelled."""
    rng = random.Random(8)
    words = [f"w{i}{chr(97 + i % 26)}" for i in range(900)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30, 80))).capitalize() + "." for _ in range(80)]
    texts += [f"{rng.choice(words)} " * rng.randrange(30, 60) + "### $$$ " * 9 for _ in range(40)]
    texts += [t for t in texts[:15]]
    for t in texts[15:30]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    labels = [(i, int("###" not in t), 0) for i, t in enumerate(texts) if i % 2 == 0]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}", rows


def test_stages_keep_what_a_plain_version_keeps(spark, sf):
    path, rows = sf
    out = corpus_pipeline.run(spark, path).collect()
    docs = spark.read.parquet(f"{path}/documents.parquet")
    scores = quality_classifier.score_quality(docs, spark.read.parquet(f"{path}/labels.parquet"), [F.col("doc_id")]).collect()
    good = {r["doc_id"] for r in scores if r["predicted"] == 1}
    assert good == {i for i, t, *_ in rows if "###" not in t}
    last = {}
    for i, t, *_ in rows:
        if i in good:
            last[t] = max(last.get(t, -1), i)
    groups = brute_components([(i, t) for t, i in last.items()], 5, 4, 5)
    want = {i for i, (_, c) in groups.items() if c == i}
    assert {r["doc_id"] for r in out} == want and len(out) == len(want)
    assert all(r["lossless"] for r in out)
    p = pieces.load(open(pieces.MODEL, "rb").read())
    for r in out[:5]:
        assert pieces.decode_batch(p, np.array(r["ids"]), np.array([0, len(r["ids"])])) == [r["text"].encode()]


def test_mixing_stage_orders_rows_and_keeps_all(spark, sf):
    path, rows = sf
    docs = spark.read.parquet(f"{path}/documents.parquet")
    mixed = corpus_pipeline.mix_sources(spark, docs, path)
    assert mixed.columns == docs.columns and sorted(r["doc_id"] for r in mixed.collect()) == [r[0] for r in rows]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, tmp_path, name, stage):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long, more string")
    for clash in ("_row", "score", "ids", "_digest", "slot", "n_words"):
        docs = docs.withColumn(clash, F.lit("clash"))
    spark.createDataFrame([(1, 1, 0, "x", 0.5), (None, 0, 0, "x", 0.5), (4, None, None, None, None)], LABELS).write.parquet(f"file://{tmp_path}/labels.parquet")
    out = stage(spark, docs, f"file://{tmp_path}")
    last = name == corpus_pipeline.STAGES[-1][0]
    assert last or out.columns == docs.columns
    assert 0 < out.count() <= len(ROWS)
    assert stage(spark, docs.limit(0), f"file://{tmp_path}").count() == 0
