"""A drift alarm on the flag rate: one cumulative sum for each corpus, over a table or over a stream.

The sum grows by what a box exceeds the allowed rate and never falls below zero; it alarms when it passes a limit. Over a
table it is a running sum less its least value so far, which windows give; over a stream it is the state of a corpus,
and a timer tells of corpora that fell silent. Both count in whole numbers, so they agree exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a flagged box adds and an unflagged one takes away, and the limit: an allowed rate of 30 of 100 boxes.
UP, DOWN, LIMIT = 70, 30, 600
ALARM = "corpus string, ts timestamp, id long, level long, alarm string"


def cusum(boxes: DataFrame, up: int = UP, down: int = DOWN, limit: int = LIMIT) -> DataFrame:
    """boxes (corpus, ts, id, flagged) -> corpus, id, level and alarm (true where the level passes the limit), in order of ts and id."""
    order = W.partitionBy("corpus").orderBy("ts", "id")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    own = boxes.withColumn("_sum", F.sum(F.when(F.col("flagged"), F.lit(up)).otherwise(F.lit(-down)).cast("long")).over(upto))
    own = own.withColumn("level", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto)))
    before = F.coalesce(F.lag("level").over(order), F.lit(0))
    return own.select("corpus", "id", "level", ((F.col("level") > limit) & (before <= limit)).alias("alarm"))


class Cusum(StatefulProcessor):
    """A corpus's level as value state; rows of a batch are taken in order; a timer fires after so long without a box."""

    def __init__(self, silence_ms: int, up: int = UP, down: int = DOWN, limit: int = LIMIT):
        self.silence_ms, self.up, self.down, self.limit = silence_ms, up, down, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.level = handle.getValueState("level", "level long, last timestamp")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "id"])
        level = self.level.get()[0] if self.level.exists() else 0
        out = []
        for ts, i, flagged in zip(frame["ts"], frame["id"], frame["flagged"], strict=True):
            before, level = level, max(0, level + (self.up if flagged else -self.down))
            if level > self.limit >= before:
                out.append((key[0], ts, i, level, "drift"))
        last = frame["ts"].max()
        self.level.update((level, last.to_pydatetime()))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer(int(last.timestamp() * 1000) + self.silence_ms)
        yield pd.DataFrame(out, columns=["corpus", "ts", "id", "level", "alarm"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        level, last = self.level.get()
        yield pd.DataFrame([(key[0], pd.Timestamp(last), -1, level, "silent")], columns=["corpus", "ts", "id", "level", "alarm"])

    def close(self) -> None:
        pass


def alarms(boxes: DataFrame, late: str = "1 hour", silence_ms: int = 86_400_000, up: int = UP, down: int = DOWN, limit: int = LIMIT) -> DataFrame:
    """A stream of boxes (corpus, ts, id, flagged) -> its alarms: drift at a box, or silent with id -1.

    A micro-batch's rows of a corpus are sorted in one task. Needs the RocksDB state store.
    """
    own = boxes.select("corpus", "ts", "id", "flagged").withWatermark("ts", late)
    return own.groupBy("corpus").transformWithStateInPandas(Cusum(silence_ms, up, down, limit), outputStructType=ALARM, outputMode="Append", timeMode="EventTime")
