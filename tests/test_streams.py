"""Streams: state that ends, and log files that grow and rotate."""

import datetime
import json
import math
import random

import pytest

from strataq.sources.log_stream import LogStream
from strataq.streaming import expiring

BORN = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)


def at(seconds):
    return BORN + datetime.timedelta(seconds=seconds)


def feed(spark, folder, shape, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{folder}/b{i}")
    return spark.readStream.schema(shape).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder))


def run(df, tmp_path, mode):
    rows = []
    q = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: rows.append((n, b.collect()))).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return rows, q


def test_levels_equal_the_closed_form_and_end(spark, tmp_path):
    rng = random.Random(1)
    deposits = [(t, s, a) for t, s, a in ((rng.choice(["x", "y", None]), rng.uniform(0, 500), rng.uniform(0, 2)) for _ in range(120))]
    rng.shuffle(deposits)
    rows = [(t, at(s), a) for t, s, a in deposits]
    batches = [rows[:40], rows[40:80], [*rows[80:], ("x", None, 1.0)], [("late", at(100_000), 1e-6)], [("late", at(200_000), 1e-6)]]
    df = feed(spark, tmp_path / "in", "topic string, ts timestamp, amount double", batches)
    out, q = run(expiring.stream_levels(df, "1 hour", 60.0), tmp_path, "update")
    last = {}
    for _, found in sorted(out):
        last |= {r["topic"]: (r["at"], r["level"]) for r in found}
    for topic in ("x", "y", None):
        own = [(s, a) for t, s, a in deposits if t == topic]
        end = max(s for s, _ in own)
        want = sum(a * math.exp(-math.log(2) * (end - s) / 60) for s, a in own)
        assert abs(last[topic][0] - BORN.timestamp() - end) < 1e-3 and abs(last[topic][1] - want) < 1e-6
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(states) >= 3 and states[-1] == 0


def test_saturated_signatures_start_anew_after_the_horizon(spark, tmp_path):
    batches = [[("a", at(10 * i), i) for i in range(5)] + [("b", at(3), 50)], [("a", at(60), 6)], [("c", at(9000), 7)], [("a", at(9001), 8), ("d", None, 9)]]
    df = feed(spark, tmp_path / "in", "signature string, ts timestamp, row long", batches)
    out, _ = run(expiring.stream_unsaturated(df, "0 seconds", 3, 600.0), tmp_path, "append")
    assert sorted((r["signature"], r["row"]) for _, found in out for r in found) == [("a", 0), ("a", 1), ("a", 2), ("a", 8), ("b", 50), ("c", 7)]


@pytest.fixture
def logs(spark, tmp_path):
    spark.dataSource.register(LogStream)
    (tmp_path / "logs").mkdir()

    def take(split="7"):
        """Run until all lines that are there are read, and return the new ones."""
        rows = []
        df = spark.readStream.format("log_lines").option("split", split).option("suffix", ".log").load(f"file://{tmp_path}/logs")
        q = df.writeStream.foreachBatch(lambda b, n: rows.extend(b.select("line", "bad").collect())).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r["line"], r["bad"]) for r in rows)

    return tmp_path / "logs", take


def line(i):
    return json.dumps({"id": i}) + "\n"


def test_each_line_comes_once_while_files_grow_and_rotate(logs):
    folder, take = logs
    now = folder / "app.log"
    good = lambda *ids: [(line(i).strip(), False) for i in ids]
    now.write_text(line(1) + line(2) + '{"id": 3')
    (folder / "other.log").write_text(line(100) + "\n{broken\n[4]\n")
    (folder / "skip.txt").write_text(line(999))
    assert take() == sorted(good(1, 2, 100) + [("[4]", True), ("{broken", True)])
    assert take() == []
    with now.open("a") as f:
        f.write("}\n" + line(4))
    assert take() == sorted(good(3, 4))
    # Rotated: what was added before goes on, and the new file begins at its start.
    with now.open("a") as f:
        f.write(line(5))
    now.rename(folder / "app.log.1")
    now.write_text(line(6) + line(7))
    assert take("1000000") == sorted(good(5, 6, 7))
    with now.open("a") as f:
        f.write(line(8))
    (folder / "app.log.1").rename(folder / "app.log.2")
    assert take() == good(8) and take() == []


def test_a_batch_that_failed_is_read_again_whole(spark, logs, tmp_path):
    folder, take = logs
    (folder / "a.log").write_text(line(1) + line(2))

    def fail(batch, n):
        batch.count()
        raise ValueError("sink")

    df = spark.readStream.format("log_lines").load(f"file://{tmp_path}/logs")
    q = df.writeStream.foreachBatch(fail).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="sink"):
        q.awaitTermination()
    (folder / "a.log").rename(folder / "a.log.1")
    (folder / "b.log").write_text(line(3))
    # The batch that failed comes first and as it was planned, under the file's new name; what is new comes after it.
    assert take() == [(line(i).strip(), False) for i in (1, 2)]
    assert take() == [(line(3).strip(), False)] and take() == []
