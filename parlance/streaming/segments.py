"""Segmentation of frames that arrive as a stream: gaps and islands with state, in the order of event time.

A frame is a row of a recording with a time and whether it has speech. Frames wait until the watermark has passed them, so that those that
come late, but not too late, still take their place; then they are numbered in the order of time (and of a column that
breaks ties), and go through the islands: the state of a recording is its number of frames, the first and the last frame of the open island,
and the frames that wait. An island is closed, and returned, by `min_silence` silent frames; the last one by a timer, once the recording
has had no frame for `idle`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parlance.operators.naming import fresh
from parlance.session import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = ["start_frame", "end_frame", "tail"]


def advance(n: int, start: int, last: int, speech: list[bool], quiet: int, short_end: bool = True) -> tuple[int, int, int, list[tuple[int, int, bool]]]:
    """The state after some more frames, and the islands that they close; `start` is -1 while no island is open."""
    closed = []
    for s in speech:
        if s:
            if start < 0:
                start = n
            last = n
        n += 1
        if start >= 0 and n - 1 - last >= quiet:
            closed.append((start, last if short_end else last + 1, False))
            start = -1
    return n, start, last, closed


class Segmenter(StatefulProcessor):
    def __init__(self, keys: list[str], names: list[str], quiet: int, idle_ms: int, short_end: bool):
        self.keys, self.names, self.quiet, self.idle_ms, self.short_end = keys, names, quiet, idle_ms, short_end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "n long, start long, last long, seen long")
        self.waiting = handle.getListState("waiting", "ms long, tie long, speech boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        frames = pd.concat(list(rows))
        # what comes after the watermark has passed it is too late: its place is taken
        new = [(int(ms), int(tie), bool(s)) for ms, tie, s in zip(*(frames[c] for c in self.names), strict=True) if ms > now]
        waiting = [tuple(x) for x in self.waiting.get()] + new if self.waiting.exists() else new
        yield from self._passed(key, waiting, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._passed(key, [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else [], timerValues.getCurrentWatermarkInMs())

    def _passed(self, key, waiting: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        """Take the frames that the watermark has passed through the islands, and set the timer for the next ones, or for the end."""
        n, start, last, seen = (int(x) for x in self.open.get()) if self.open.exists() else (0, -1, -1, -1)
        waiting.sort()
        ready = [x for x in waiting if x[0] <= now]
        rest = waiting[len(ready) :]
        n, start, last, closed = advance(n, start, last, [x[2] for x in ready], self.quiet, self.short_end)
        seen = max([seen, *(x[0] for x in ready)])
        ended = not rest and 0 <= seen and seen + self.idle_ms <= now
        if ended and start >= 0:
            closed.append((start, n, True))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if ended:
            self.open.clear()
            self.waiting.clear()
        else:
            self.open.update((n, start, last, seen))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            self.handle.registerTimer(rest[-1][0] if rest else seen + self.idle_ms)
        if closed:
            out = pd.DataFrame(closed, columns=_OUT)
            for name, value in reversed(list(zip(self.keys, key, strict=True))):
                out.insert(0, name, value)
            yield out

    def close(self) -> None:
        pass


def segment_stream(frames: DataFrame, by: list[str], time: str, tie: str, speech: str, min_silence: int, late: str = "10 minutes", idle: str = "1 hour", short_end: bool = True) -> DataFrame:
    """`by, start_frame, end_frame, tail` of the islands of a stream of frames, as `audio.frame_segments` has them, once they are closed.

    `tie` is a number that orders frames of one time. The state store has to be RocksDB's, which is set here for the session.
    """
    spark = ship(frames.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    [idle_ms] = spark.sql(f"SELECT CAST(unix_millis(timestamp_seconds(0) + INTERVAL {idle}) AS BIGINT)").first()
    kinds = dict(frames.dtypes)
    # no underscore in front: rows of the stream become named tuples, which have no such names
    ms, order, spoken = fresh([*by, time], "frame_ms", "frame_tie", "frame_speech")
    rows = frames.withWatermark(time, late).select(*by, time, F.unix_millis(time).alias(ms), F.col(tie).cast("long").alias(order), F.coalesce(F.col(speech), F.lit(False)).alias(spoken))
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in by] + ["start_frame long, end_frame long, tail boolean"])
    return rows.groupBy(*by).transformWithStateInPandas(Segmenter(by, [ms, order, spoken], min_silence, idle_ms, short_end), schema, "Append", "EventTime")
