"""Recovery from loss and reordering with state: the reorder buffer of each stream, with event-time timers for what is missed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "stream_id long, event string, sequence long, upto long, at_ms long"


class Recovery(StatefulProcessor):
    """Events of a stream: released, late, repeated (a packet), nack and request_keyframe (for sequence to upto).

    State: the next sequence to release, the highest seen and the clock; packets held back; ranges that are missed with
    their deadlines; ranges given up, which tell a late packet from a repeated one. ``keep_ms`` bounds how long the last
    are kept (0: for ever); after that a packet of them counts as repeated.
    """

    def __init__(self, wait_ms: int, first: int = 1, keep_ms: int = 0):
        self.wait_ms, self.first, self.keep_ms = wait_ms, first, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, high long, now long")
        self.held = handle.getMapState("held", "sequence long", "arrival long")
        self.missed = handle.getMapState("missed", "first long", "last long, deadline long")
        self.lost = handle.getMapState("lost", "first long", "last long, since long")

    def _load(self) -> None:
        self.next, self.high, self.now = self.place.get() if self.place.exists() else (self.first, self.first - 1, 0)
        self.out: list[tuple] = []
        self.gaps = {k[0]: (v[0], v[1]) for k, v in self.missed.iterator()}

    def _store(self, key: tuple) -> Iterator[pd.DataFrame]:
        self.place.update((self.next, self.high, self.now))
        if self.out:
            yield pd.DataFrame([(key[0], *row) for row in self.out], columns=["stream_id", "event", "sequence", "upto", "at_ms"])

    def _release(self, at: int) -> None:
        """Release what is next, passing over what was given up."""
        while True:
            if self.held.containsKey((self.next,)):
                self.held.removeKey((self.next,))
                self.out.append(("released", self.next, self.next, at))
                self.next += 1
            elif self.lost.containsKey((self.next,)):
                self.next = self.lost.getValue((self.next,))[0] + 1
            else:
                return

    def _give_up(self, before: int) -> None:
        """Give up ranges whose deadline is before ``before``, in the order of deadlines."""
        for begin, (end, deadline) in sorted(self.gaps.items(), key=lambda g: (g[1][1], g[0])):
            if deadline < before:
                del self.gaps[begin]
                self.missed.removeKey((begin,))
                self.lost.updateValue((begin,), (end, deadline))
                self.out.append(("request_keyframe", begin, end, deadline))
                self._release(deadline)

    def _fill(self, sequence: int) -> bool:
        """Take a sequence out of the range that misses it."""
        begin = max((b for b in self.gaps if b <= sequence), default=None)
        if begin is None or self.gaps[begin][0] < sequence:
            return False
        end, deadline = self.gaps.pop(begin)
        self.missed.removeKey((begin,))
        for a, b in ((begin, sequence - 1), (sequence + 1, end)):
            if a <= b:
                self.gaps[a] = b, deadline
                self.missed.updateValue((a,), (b, deadline))
        return True

    def _take(self, sequence: int, arrival: int) -> None:
        self.now = max(self.now, arrival)
        self._give_up(self.now)
        if sequence > self.high:
            if sequence > self.high + 1:
                deadline = self.now + self.wait_ms
                self.gaps[self.high + 1] = sequence - 1, deadline
                self.missed.updateValue((self.high + 1,), (sequence - 1, deadline))
                self.handle.registerTimer(deadline)
                self.out.append(("nack", self.high + 1, sequence - 1, self.now))
            self.high = sequence
        elif not self._fill(sequence):
            late = next(((k[0], v[0], v[1]) for k, v in self.lost.iterator() if k[0] <= sequence <= v[0]), None)
            if late:  # once it came, it counts as repeated
                self.lost.removeKey((late[0],))
                for a, b in ((late[0], sequence - 1), (sequence + 1, late[1])):
                    if a <= b:
                        self.lost.updateValue((a,), (b, late[2]))
            self.out.append(("late" if late else "repeated", sequence, sequence, self.now))
            return
        self.held.updateValue((sequence,), (self.now,))
        self._release(self.now)

    def _forget(self) -> None:
        for k, v in list(self.lost.iterator()) if self.keep_ms else []:
            if v[1] + self.keep_ms < self.now and v[0] < self.next:
                self.lost.removeKey(k)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        arrived = pd.concat(list(rows), ignore_index=True).sort_values(["arrival_ms", "sequence"])
        for sequence, arrival in zip(arrived["sequence"].tolist(), arrived["arrival_ms"].tolist()):
            self._take(int(sequence), int(arrival))
        self._forget()
        yield from self._store(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        self._give_up(timerValues.getCurrentWatermarkInMs())
        yield from self._store(key)

    def close(self) -> None:
        pass


def recover(arrivals: DataFrame, wait_ms: int, first: int = 1, delay: str = "0 seconds", keep_ms: int = 0) -> DataFrame:
    """Events (OUT) of streams of stream_id, sequence, arrival_ms; asks for the RocksDB state store.

    Arrival times may not go back from batch to batch by more than ``delay``; within a batch rows are put in their order. Rows with nulls are no packets.
    """
    rows = arrivals.where("stream_id is not null and sequence is not null and arrival_ms is not null").select("stream_id", "sequence", "arrival_ms", F.timestamp_millis("arrival_ms").alias("arrived"))
    return rows.withWatermark("arrived", delay).groupBy("stream_id").transformWithStateInPandas(Recovery(wait_ms, first, keep_ms), OUT, "Append", "EventTime")
