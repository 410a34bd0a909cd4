"""Stateful jobs that take the events of a key in the order of their own time, whatever order they come in.

Keys are put into groups. Events wait in their group's list until the watermark has passed them, so none can come before them any more; a timer wakes the
group. They are then taken by (ts, event_id), and only what a job must remember of them stays. Results come one lateness after their
events; a row behind the watermark of the trigger before, whose like were taken then, is dropped by Spark.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .ledger import LATENESS

DAY_MS = 24 * 3600 * 1000


#: Groups of keys. A call from the JVM for each key and trigger would cost more than the work; a group holds its share of the keys.
GROUPS = 256


class _InOrder(StatefulProcessor):
    """Rows (event_id, key, us, kind) of a group of keys; `us` is the event's time in microseconds, a key is text. A job has the schema of a key's
    state and a `step`.

    What waits and what is remembered of the group's keys are two lists, read and written once a trigger; a timer stands for the earliest of them.
    """

    remembers: str
    columns: tuple[str, ...]

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id bigint, key string, us bigint, kind string")
        self.known = handle.getListState("known", f"key string, {self.remembers}")

    def _wake(self, events: list[tuple], known: dict) -> None:
        """A timer for the time when the watermark is behind every event of the earliest millisecond, or a key has been idle."""
        times = [min(e[2] for e in events) // 1000] if events else []
        times += [min(s[0] for s in known.values()) + self.idle_ms] if known else []
        if times:
            self.handle.registerTimer(min(times) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [e for batch in rows for e in zip(*(batch[c].tolist() for c in ("event_id", "key", "us", "kind")), strict=True)]
        self.waiting.appendList(new)
        self._wake(new, {})
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        events = sorted(self.waiting.get(), key=lambda x: (x[2], x[0]))
        due = bisect_left(events, mark, key=lambda x: x[2] // 1000)
        before = {k: tuple(state) for k, *state in self.known.get()}
        known, found = dict(before), []
        for event, k, us, kind in events[:due]:
            state = known.pop(k, None)
            if state is not None and us // 1000 - state[0] > self.idle_ms:
                state = None
            state = self.step(state, event, us // 1000, kind, k, found)
            if state is not None:
                known[k] = state
        known = {k: state for k, state in known.items() if state[0] + self.idle_ms >= mark}
        self._keep(self.waiting, events[due:], due > 0)
        self._keep(self.known, [(k, *state) for k, state in known.items()], known != before)
        self._wake(events[due:], known)
        yield self._frame(found)

    @staticmethod
    def _keep(place, rows: list[tuple], changed: bool) -> None:
        if changed and rows:
            place.put(rows)
        elif changed:
            place.clear()

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=list(self.columns))
        return frame.astype({c: "Int64" for c in ("event_id", "generation") if c in self.columns})

    def close(self) -> None:
        pass


class _Versions(_InOrder):
    """State: time of the last event, generation, generation of the last scan (-1: none)."""

    remembers = "ms bigint, generation bigint, scanned bigint"
    columns = ("event_id", "key", "generation", "verdict")

    def step(self, state, event, ms, kind, key, found):
        if kind == "remove":
            return None
        if kind in ("navigate", "scan"):
            _, generation, scanned = state or (0, 0, -1)
            generation += kind == "navigate"
            return ms, generation, generation if kind == "scan" else scanned
        if state is None:
            found.append((event, key, None, "gone"))
            return None
        _, generation, scanned = state
        found.append((event, key, generation, "not scanned" if scanned < 0 else "navigated" if scanned < generation else "current"))
        return ms, generation, scanned


class _Once(_InOrder):
    """State: time of the last event that was let in."""

    remembers = "ms bigint"
    columns = ("event_id", "key")

    def step(self, state, event, ms, kind, key, found):
        if state is not None:
            return state
        found.append((event, key))
        return (ms,)


def _run(events: DataFrame, processor: _InOrder, schema: str) -> DataFrame:
    kind = events.schema["key"].dataType
    at = F.col("ts").cast("timestamp")
    rows = events.select("event_id", F.col("key").cast("string").alias("key"), at.alias("ts"), F.unix_micros(at).alias("us"), "kind")
    rows = rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS))).withWatermark("ts", LATENESS)
    out = rows.groupBy("group").transformWithStateInPandas(processor, schema, "Append", "eventTime")
    return out.withColumn("key", F.col("key").cast(kind))


def versions(log: DataFrame, idle_ms: int = 30 * DAY_MS) -> DataFrame:
    """(event_id, key, generation, verdict) of answers in a log (event_id, key, ts, kind), as operators.ledgers.version_check says.

    A key's state is three numbers; it goes with the key's removal, and when nothing was heard of the key for `idle_ms`.
    """
    return _run(log, _Versions(idle_ms), "event_id bigint, key string, generation bigint, verdict string")


def admitted_once(jobs: DataFrame, horizon_ms: int) -> DataFrame:
    """(event_id, key) of jobs (event_id, key, ts) of which each key is let in once, and again when more than `horizon_ms` have passed since.

    What is let in follows from the jobs' own times alone, not from how they were cut into triggers.
    """
    return _run(jobs.withColumn("kind", F.lit("")), _Once(horizon_ms), "event_id bigint, key string")
