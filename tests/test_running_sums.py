"""Running sums over ranges, and the metrics on them, against plain ones."""

import random
import statistics

import pytest

from strataq.operators import metrics


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_running_sums_equal_a_loop(spark, ranges):
    rng = random.Random(ranges)
    rows = [(x, rng.randrange(5)) for x in rng.sample([k / 7 for k in range(-300, 300)], 200)]
    got = {r["x"]: r["sum_n"] for r in metrics.running(spark.createDataFrame(rows, "x double, n long"), "x", ["n"], ranges).collect()}
    at, want = 0, {}
    for x, n in sorted(rows):
        want[x] = at
        at += n
    assert got == want
    assert metrics.running(spark.createDataFrame([], "x double, n long"), "x", ["n"], ranges).count() == 0


def test_best_threshold_and_ranks(spark):
    rng = random.Random(1)
    rows = [(int(rng.random() < s), s) for s in (round(rng.random(), 2) for _ in range(300))]
    df = spark.createDataFrame(rows, "label int, score double")
    f1 = lambda t: 2 * sum(y for y, s in rows if s >= t) / (sum(s >= t for _, s in rows) + sum(y for y, _ in rows))
    best = max((f1(t), t) for t in {s for _, s in rows})
    got = metrics.best_f1(df, "label", "score").first()
    assert (got["f1"], got["threshold"]) == pytest.approx(best)
    rank = lambda v, vs: sum(x < v for x in vs) + (sum(x == v for x in vs) + 1) / 2
    a, b = ([rank(r[k], [x[k] for x in rows]) for r in rows] for k in (0, 1))
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    want = sum((x - ma) * (y - mb) for x, y in zip(a, b)) / (sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b)) ** 0.5
    assert metrics.spearman(df, "label", "score").first()["rho"] == pytest.approx(want)


@pytest.mark.parametrize("ranges", [1, 3, 200])
def test_windows_over_ranges_of_any_number(spark, ranges):
    rng = random.Random(5)
    values = [rng.gauss(10, 1) if i % 9 else 3.0 for i in range(70)]
    rows = [(float(3 * i), v if i % 11 else None) for i, v in enumerate(values)]
    rng.shuffle(rows)
    got = {r["at"]: (r["z"], r["drift"], r["rollback"]) for r in metrics.zscores(spark.createDataFrame(rows, "at double, v double"), "at", "v", ranges=ranges).collect()}
    rows.sort()
    last = False
    for i, (at, v) in enumerate(rows):
        before = [x for _, x in rows[max(0, i - 10) : i] if x is not None]
        z = None if len(before) < 2 or v is None else (v - statistics.fmean(before)) / statistics.stdev(before)
        drift = z is not None and z < -2
        assert got[at][1:] == (drift, drift and last) and (got[at][0] is None) == (z is None) and (z is None or abs(got[at][0] - z) < 1e-9)
        last = drift
    assert sum(x[1] for x in got.values()) > 2
