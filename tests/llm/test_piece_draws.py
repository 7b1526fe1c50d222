"""Every occurrence of a unit draws its merge-dropout for itself."""

import numpy as np

from strataq.llm import pieces


def test_sharing_equals_merging_every_occurrence_alone(monkeypatch):
    p = pieces.load(open(pieces.MODEL, "rb").read())
    texts = ["the information of the network is informative\nand so on " * 30, "", "Grüße 日本 😀 ▁ information", "x" * 130 + " the end"]
    salts = [5, 6, 7, 2**63 - 1]
    for cached in (pieces.CACHED, 60):
        monkeypatch.setattr(pieces, "CACHED", cached)
        cache = pieces.Segments()
        for seed, dropout in ((3, 0.1), (3, 0.5), (4, 0.1), (3, 1.0)):
            points, first, per_text = pieces._units(texts)
            sizes = np.diff(np.append(first, len(points)))
            key = pieces._occurrence_keys(pieces._unit_hashes(points, first, sizes), salts, per_text, seed)
            want, counts = pieces.segment(p, points, first, sizes, key, dropout)
            ids, starts = pieces.encode_batch(p, texts, salts, seed, dropout, cache)
            assert ids.tolist() == want.tolist()
            assert np.diff(starts).tolist() == [int(c.sum()) for c in np.split(counts, np.cumsum(per_text)[:-1])]


def test_a_frequent_unit_varies_at_the_dropout_rate():
    p = pieces.load(open(pieces.MODEL, "rb").read())
    n = 4000
    ids, starts = pieces.encode_batch(p, [" information"] * n, list(range(n)), 17, 0.1)
    seen = [tuple(ids[a:b].tolist()) for a, b in zip(starts, starts[1:])]
    assert len(set(seen)) > 8
    # The first merge is skipped at the rate itself, not at a multiple of an eighth.
    points, first, per_text = pieces._units(["information"] * n)
    sizes = np.diff(np.append(first, len(points)))
    key = pieces._occurrence_keys(pieces._unit_hashes(points, first, sizes), list(range(n)), per_text, 17)
    cache = pieces.Segments()
    at = cache.need(p, points, first[:1], sizes[:1], np.zeros(1, np.uint64), np.zeros((1, 0), np.int16))
    skipped = cache.first_skip(np.repeat(at, n), key, np.zeros(n, np.int64), 0.1) == 0
    assert abs(skipped.mean() - 0.1) < 0.02
