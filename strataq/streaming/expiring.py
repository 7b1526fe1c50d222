"""Streams with state that ends: decayed levels until they fade, counts until nothing is seen for a while.

State belongs to a key and is dropped by a timer on event time, once the watermark has passed the moment at
which it says nothing any more. Rows later than the watermark are dropped as in any windowed stream. The
session needs the RocksDB state store, see ``strataq.session.SETTINGS``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from strataq.streaming.state import HALF_LIFE

FLOOR = 0.01


class _Levels(StatefulProcessor):
    """The decayed sum of deposits at the time of the last one; older deposits that come late count with the decay they have had."""

    def __init__(self, length: float, floor: float):
        self.rate, self.floor = math.log(2) / length, floor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.level = handle.getValueState("level", "value double, at double")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        value, at = self.level.get() if self.level.exists() else (0.0, None)
        for batch in rows:
            for ts, amount in zip(batch["at"], batch["amount"]):
                at = ts if at is None else at
                later = max(at, ts)
                value = value * math.exp(-self.rate * (later - at)) + amount * math.exp(-self.rate * (later - ts))
                at = later
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if value >= self.floor:
            self.level.update((float(value), float(at)))
            self.handle.registerTimer(math.ceil(1000 * (at + math.log(value / self.floor) / self.rate)))
        else:
            self.level.clear()
        yield pd.DataFrame({"topic": [key[0]], "at": [float(at)], "level": [float(value)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.level.clear()
        yield from ()

    def close(self) -> None:
        pass


class _Counts(StatefulProcessor):
    """Passes a key's first rows, and again those after it was not seen for the horizon."""

    def __init__(self, most: int, horizon: float):
        self.most, self.horizon = most, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n bigint, at double")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        n, at = self.seen.get() if self.seen.exists() else (0, -math.inf)
        passed = []
        for batch in rows:
            for ts, row in sorted(zip(batch["at"], batch["row"])):
                n = 0 if ts > at + self.horizon else n
                if n < self.most:
                    passed.append((key[0], row))
                n, at = n + 1, max(at, ts)
        if passed:
            yield pd.DataFrame(passed, columns=["signature", "row"])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.seen.update((int(min(n, self.most)), float(at)))
        self.handle.registerTimer(math.ceil(1000 * (at + self.horizon)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_levels(deposits: DataFrame, late: str, length: float = HALF_LIFE, floor: float = FLOOR) -> DataFrame:
    """(topic, at, level) after each micro-batch of a stream (topic, ts timestamp, amount), for the topics in it.

    Rows within a batch come in any order. A topic's state ends when the watermark, ``late`` behind the
    newest row, passes the time at which its level is below ``floor``; amounts are not negative. A null topic is a topic;
    rows without a time or an amount are left out.
    """
    rows = deposits.where("ts IS NOT NULL AND amount IS NOT NULL").withWatermark("ts", late)
    rows = rows.select("topic", "ts", (F.unix_micros("ts") / 1e6).alias("at"), F.col("amount").cast("double").alias("amount"))
    return rows.groupBy("topic").transformWithStateInPandas(_Levels(length, floor), "topic string, at double, level double", "Update", "EventTime")


def stream_unsaturated(log: DataFrame, late: str, most: int = 3, horizon: float = 3600.0) -> DataFrame:
    """(signature, row) of a stream (signature, ts timestamp, row): the first ``most`` rows of a signature; it starts anew with a row
    ``horizon`` seconds past the last, and its state ends when the watermark is. Rows without a time are left out."""
    rows = log.where("ts IS NOT NULL").withWatermark("ts", late).select("signature", "ts", (F.unix_micros("ts") / 1e6).alias("at"), F.col("row").cast("long").alias("row"))
    return rows.groupBy("signature").transformWithStateInPandas(_Counts(most, horizon), "signature string, row bigint", "Append", "EventTime")
