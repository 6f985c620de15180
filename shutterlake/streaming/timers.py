"""Timers on streams: one refresh after a burst of triggers, and answers that a newer request has outdated.

Both are state machines by key on event time. A timer runs when the watermark has
passed it, i.e. when everything before it has been seen, so results do not depend
on how rows were cut into batches, and a replay from a checkpoint gives the same.
State is dropped with the timer that ends its use. They need the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(column: pd.Series) -> list[int]:
    return column.to_numpy("datetime64[us]").astype("int64").tolist()


def _due(micros: int) -> int:
    """The millisecond at which a timer for a moment may run."""
    return -(-micros // 1000)


class _Debounce(StatefulProcessor):
    """Keeps the triggers of a key that have not been answered; the timer of the last one of a burst fires."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for at in _micros(frame["ts"]):
                self.waiting.appendValue((at,))
                self.handle.registerTimer(_due(at + self.quiet))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        waiting = sorted(at for (at,) in self.waiting.get())
        fired, n = [], 0
        for i, at in enumerate(waiting):  # all bursts that this timer may end, in order
            if _due(at + self.quiet) > due:
                break
            if i + 1 == len(waiting) or waiting[i + 1] - at > self.quiet:
                fired.append((at + self.quiet, i + 1 - n))
                n = i + 1
        if fired:
            rest = [(at,) for at in waiting[n:]]
            self.waiting.put(rest) if rest else self.waiting.clear()
            yield pd.DataFrame({"key": [key[0]] * len(fired), "fires": pd.to_datetime([f for f, _ in fired], unit="us"), "n": [c for _, c in fired]})

    def close(self) -> None:
        pass


def debounced(triggers: DataFrame, quiet_ms: int, late: str = "1 minute") -> DataFrame:
    """key, fires, n for a stream of triggers (key, ts): one row a burst, ``quiet_ms`` after its last trigger, with their number."""
    rows = triggers.select("key", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").transformWithStateInPandas(_Debounce(quiet_ms * 1000), f"key {kind}, fires timestamp, n long", "Append", "EventTime")


class _Latest(StatefulProcessor):
    """Keeps answers until all that was asked before them is known, and of older requests their newest generation."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, answers boolean, generation long, id long")
        self.newest = handle.getValueState("newest", "generation long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for at, answers, generation, number in zip(_micros(frame["ts"]), frame["answers"].tolist(), frame["generation"].tolist(), frame["id"].tolist(), strict=True):
                self.waiting.appendValue((at, answers, generation, number))
                self.handle.registerTimer(_due(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        known = self.newest.get()
        newest, out, rest = known[0] if known else None, [], []
        for at, answers, generation, number in sorted(self.waiting.get(), key=lambda r: (r[0], r[1], r[2])):  # requests before answers of one moment
            if _due(at) > due:
                rest.append((at, answers, generation, number))
            elif not answers:
                newest = generation if newest is None else max(newest, generation)
            elif newest is None or generation >= newest:
                out.append((number, at, generation))
        if newest is not None:
            self.newest.update((newest,))
        self.waiting.put(rest) if rest else self.waiting.clear()
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "id": [i for i, _, _ in out], "ts": pd.to_datetime([a for _, a, _ in out], unit="us"), "generation": [g for _, _, g in out]})

    def close(self) -> None:
        pass


def latest_answers(messages: DataFrame, late: str = "1 minute") -> DataFrame:
    """key, id, ts, generation of the answers in a stream (key, ts, answers, generation, id) that no request of a newer generation came before."""
    rows = messages.select("key", F.col("ts").cast("timestamp").alias("ts"), "answers", F.col("generation").cast("long").alias("generation"), F.col("id").cast("long").alias("id")).withWatermark("ts", late)
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").transformWithStateInPandas(_Latest(), f"key {kind}, id long, ts timestamp, generation long", "Append", "EventTime")


def latest_answers_of(messages: DataFrame) -> DataFrame:
    """The same of a whole table."""
    before = Window.partitionBy("key").orderBy("ts", "answers", "generation").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    asked = F.max(F.when(~F.col("answers"), F.col("generation"))).over(before)
    return messages.withColumn("_newest", asked).filter(F.col("answers") & (F.col("_newest").isNull() | (F.col("generation") >= F.col("_newest")))).select("key", "id", "ts", "generation")
