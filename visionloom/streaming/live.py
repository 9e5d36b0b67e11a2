"""Stateful streams with timers: bounded log tails, and live frames of which the newest wins while a session is busy."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Lists and timers need the state store on disk; a store that the session has set itself stays."""
    if "HDFSBackedStateStoreProvider" in spark.conf.get(_STORE):
        spark.conf.set(_STORE, _ROCKS)


class _Tail(StatefulProcessor):
    def __init__(self, most_lines: int, most_bytes: int, idle_ms: int):
        self.most_lines, self.most_bytes, self.idle_ms = most_lines, most_bytes, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "line string")
        self.mark = handle.getValueState("mark", "next long")

    def _row(self, key: tuple, after: int, lines: list[str], closed: bool) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [key[0]], "first": [after - len(lines)], "next": [after], "lines": [lines], "closed": [closed]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Of a batch in any order only the last most_lines by (arrival, pos) are ever held, beside one chunk of it."""
        held: list[tuple] = []
        n = 0
        for part in rows:
            n += len(part)
            held = heapq.nlargest(self.most_lines, [*held, *zip(part["arrival"], part["pos"], part["line"])], key=lambda x: x[:2])
        before = [r[0] for r in self.lines.get()] if self.lines.exists() else []
        lines = [*before, *[x[2] for x in reversed(held)]][-self.most_lines :]
        size = sum(len(x.encode()) for x in lines)
        while len(lines) > 1 and size > self.most_bytes:
            size -= len(lines.pop(0).encode())
        after = (self.mark.get()[0] if self.mark.exists() else 0) + n
        self.lines.put([(x,) for x in lines])
        self.mark.update((after,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._row(key, after, lines, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lines = [r[0] for r in self.lines.get()] if self.lines.exists() else []
        after = self.mark.get()[0] if self.mark.exists() else 0
        self.lines.clear()
        self.mark.clear()
        yield self._row(key, after, lines, True)

    def close(self) -> None:
        pass


def bounded_tail(lines: DataFrame, most_lines: int = 1000, most_bytes: int = 1 << 20, idle_ms: int = 3_600_000) -> DataFrame:
    """Stream (run_id, first, next, lines, closed) of lines(run_id, arrival, pos, line): after each batch the last lines of
    every run that it touched, numbered from `first`; `next` is the number that its next line gets.

    A run keeps most_lines lines and most_bytes bytes at most (always its last line), so state is bounded however long the
    log. A run without lines for idle_ms is closed: its tail comes once more and its state goes; lines after that start a new
    run from 0. State is in the checkpoint: a restart goes on with the same numbers. Timers need batches without data, so
    with availableNow a query ends only where spark.sql.streaming.noDataMicroBatches.enabled is off.
    """
    use_state_store(lines.sparkSession)
    out = "run_id long, first long, next long, lines array<string>, closed boolean"
    return lines.groupBy("run_id").transformWithStateInPandas(_Tail(most_lines, most_bytes, idle_ms), out, "Update", "ProcessingTime")


class _Newest(StatefulProcessor):
    def __init__(self, busy_ms: int):
        self.busy_ms = busy_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "frame_id long, payload string")
        self.seen = handle.getValueState("seen", "newest long, received long, dropped long")

    def _out(self, key: tuple, frame: tuple, now: int) -> pd.DataFrame:
        newest, received, dropped = self.seen.get()
        self.handle.registerTimer(now + self.busy_ms)
        return pd.DataFrame({"session": [key[0]], "frame_id": [frame[0]], "payload": [frame[1]], "received": [received], "dropped": [dropped]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, received, dropped = self.seen.get() if self.seen.exists() else (-1, 0, 0)
        pending = tuple(self.pending.get()) if self.pending.exists() else None
        for part in rows:
            for frame_id, payload in zip(part["frame_id"].tolist(), part["payload"].tolist()):
                received += 1
                if frame_id <= newest:
                    dropped += 1  # older than what is shown or waits
                    continue
                dropped += pending is not None
                pending, newest = (frame_id, payload), frame_id
        self.seen.update((newest, received, dropped))
        busy = next(iter(self.handle.listTimers()), None) is not None
        if pending is None:
            return
        if busy:
            self.pending.update(pending)
            return
        self.pending.clear()
        yield self._out(key, pending, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pending.exists():
            pending = tuple(self.pending.get())
            self.pending.clear()
            yield self._out(key, pending, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def latest_wins(frames: DataFrame, busy_ms: int = 100) -> DataFrame:
    """Stream (session, frame_id, payload, received, dropped) of frames(session, frame_id, payload): what a session that is
    busy for busy_ms after each frame gets to see.

    A free session takes its newest frame at once. While it is busy only the newest frame waits; each one that it replaces,
    and each that comes behind a newer one, counts as dropped. When the time is over the waiting frame is taken. received
    and dropped are totals of the session so far; taken frames, a waiting one and dropped ones add up to received.
    State is one frame and three numbers a session.
    """
    use_state_store(frames.sparkSession)
    out = "session string, frame_id long, payload string, received long, dropped long"
    return frames.groupBy("session").transformWithStateInPandas(_Newest(busy_ms), out, "Update", "ProcessingTime")
