"""The pipeline's result carries the order of the mix."""

import random
from collections import Counter

import corpus_pipeline
from strataq.llm import mixing


def test_prefixes_of_the_result_hold_the_target_shares(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}{chr(97 + i % 26)}" for i in range(900)]
    rows = []
    for i in range(150):
        source = ("src0", "src0", "src0", "src1", "src2")[i % 5]
        rows.append((i, " ".join(rng.choice(words) for _ in range(4000)).capitalize() + ".", "en", source))
    rows += [(1000 + i, f"{rng.choice(words)} " * 40 + "### $$$ " * 9, "en", "src1") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").select("doc_id", "source", "slot", "block_offset").collect()
    assert len(out) == 150
    place = [(r["slot"], r["block_offset"]) for r in out]
    assert place == sorted(place) and len(set(place)) == len(place)
    total = sum(mixing.WEIGHTS.get(s, 1) for s in ("src0", "src1", "src2"))
    blocks, seen = Counter(), set()
    ends = {s: max(r["slot"] for r in out if r["source"] == s) for s in ("src0", "src1", "src2")}
    for r in out:
        if r["slot"] in seen or r["slot"] > min(ends.values()):
            continue
        seen.add(r["slot"])
        blocks[r["source"]] += 1
        assert all(abs(blocks[s] - len(seen) * mixing.WEIGHTS.get(s, 1) / total) < 1 for s in ends)
    assert len(seen) >= 5
