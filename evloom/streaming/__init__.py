"""Structured Streaming forms of the event operators. Event-time windows are an extension."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

QUEUE = 200
TERMINAL = ("done", "stopped", "failed")


def event_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tumbling event-time counts and sums by type, late rows within the watermark included; the input may be a stream or a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    by = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def bounded_queues(events: DataFrame, most: int = QUEUE) -> DataFrame:
    """For a stream of (key, seq, type, payload): after each batch, the size of a key's queue, which drops its oldest.

    A terminal type closes the key and frees its state.
    """

    def step(key, batches, state):
        held = list(state.get[0]) if state.exists else []
        closed = False
        for d in batches:
            d = d.sort_values("seq")
            held = (held + d["seq"].tolist())[-most:]
            closed = closed or d["type"].isin(TERMINAL).any()
        out = pd.DataFrame({"key": [key[0]], "size": [len(held)], "oldest": [held[0]], "closed": [bool(closed)]})
        if closed:
            state.remove()
        else:
            state.update((held,))
        yield out

    return events.groupBy("key").applyInPandasWithState(step, "key string, size long, oldest long, closed boolean", "held array<long>", "update", GroupStateTimeout.NoTimeout)


def process_rounds(rounds: DataFrame, handle, checkpoint: str):
    """Runs handle(batch, round) once for each micro-batch of a stream; a restart goes on after the last finished one."""
    return rounds.writeStream.foreachBatch(lambda df, n: handle(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Milliseconds of silence before a keep-alive, and between a terminal event and the end of its key.
SILENCE, LINGER = 30_000, 10_000
FEED = "key string, at long, seq long, line string, held int"


class Feed(StatefulProcessor):
    """A key's events as lines of a server-sent stream.

    State: the last QUEUE events, when something was last sent, and when a terminal event came.  Two timers a key at most: one for silence, moved
    by each event, and one that clears the key LINGER after its terminal event.
    """

    def __init__(self, silence: int = SILENCE, linger: int = LINGER, most: int = QUEUE):
        self.silence, self.linger, self.most = silence, linger, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", "seq long, line string")
        self.clock = handle.getValueState("clock", "silent long, ends long")

    def _set(self, silent: int | None, ends: int | None) -> None:
        old = self.clock.get() if self.clock.exists() else (None, None)
        for before, now in zip(old, (silent, ends), strict=True):
            if before != now and before is not None and before not in (silent, ends):
                self.handle.deleteTimer(before)
            if now is not None and before != now:
                self.handle.registerTimer(now)
        self.clock.update((silent, ends))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, new, done = timerValues.getCurrentProcessingTimeInMs(), [], False
        for d in rows:
            for seq, event, data, status in zip(d["seq"], d["event"], d["data"], d["status"], strict=True):
                new.append((int(seq), f"event: {event}\ndata: {data}\n\n"))
                done |= event == "status" and status in TERMINAL
        new.sort()
        held = ([tuple(x) for x in self.queue.get()] if self.queue.exists() else []) + new
        self.queue.put(held[-self.most :])
        ends = self.clock.get()[1] if self.clock.exists() else None
        self._set(now + self.silence, now + self.linger if done else ends)
        yield pd.DataFrame({"key": key[0], "at": now, "seq": [s for s, _ in new], "line": [x for _, x in new], "held": min(len(held), self.most)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, at = timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs()
        silent, ends = self.clock.get() if self.clock.exists() else (None, None)
        row = lambda line, held: pd.DataFrame({"key": [key[0]], "at": [now], "seq": [None], "line": [line], "held": [held]}).astype({"seq": "Int64"})
        if ends is not None and at >= ends:
            if silent is not None and silent != at:
                self.handle.deleteTimer(silent)
            self.queue.clear()
            self.clock.clear()
            yield row("", 0)
        elif at == silent:
            self._set(now + self.silence, ends)
            yield row(": keepalive\n\n", len(list(self.queue.get())) if self.queue.exists() else 0)

    def close(self) -> None:
        pass


def event_feed(events: DataFrame, silence: int = SILENCE, linger: int = LINGER, most: int = QUEUE) -> DataFrame:
    """key, at (ms), seq, line, held for a stream of (key, seq, event, data, status): each event as a line of a server-sent stream, a keep-alive after each
    silence, and an empty line when a key is cleared, `linger` after an event named status with a terminal status.  held: events in the key's queue, of which the oldest are dropped.

    Times are processing times.  Keys are hashed over all tasks; state is in RocksDB, which spark.sql.streaming.stateStore.providerClass must name.
    """
    return events.groupBy("key").transformWithStateInPandas(Feed(silence, linger, most), FEED, "Append", "ProcessingTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
