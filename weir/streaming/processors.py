"""Streams with keyed state and timers: leases that run out, bursts of changes that settle, and what was seen within a time.

The first two hold a key's events in list state until the watermark has passed them; an event-time timer
of the key then works them off in their order, so the result doesn't depend on the order of arrival.
What comes later than the watermark allows is dropped. The state of a key is what it holds within the
watermark's delay and a few numbers, and is cleared once the key is done.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weir.operators.queue import RETENTION

#: What a change becomes after the one before it in its burst; all others stay as they are, "" is no change.
FOLDED = {("created", "deleted"): "", ("created", "modified"): "created", ("deleted", "created"): "modified", ("renamed", "created"): "modified"}
#: The state that an action puts a task into.
BECOMES = {"add": "ready", "claim": "in_progress", "extend": "in_progress", "complete": "completed", "cancel": "canceled"}
ENDS = ("complete", "cancel")


class Held(StatefulProcessor):
    """Events of a key, held until the watermark has passed them; ``fields`` are their columns, the first two the second and the id."""

    fields, numbers = "", ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.fields)
        self.now = handle.getValueState("now", self.numbers)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in self.fields.split(", ")]
        fresh = [tuple(r) for f in rows for r in f[names].astype({n: object for n in names}).itertuples(index=False)]
        passed = timerValues.getCurrentWatermarkInMs()
        fresh = [e for e in fresh if e[0] * 1000 > passed]  # what has been worked off is not opened again
        if fresh:
            self.held.appendList(fresh)
            self._wake(min(e[0] for e in fresh))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() / 1000
        events = sorted(tuple(e) for e in self.held.get()) if self.held.exists() else []
        now = tuple(self.now.get()) if self.now.exists() else None
        out, rest, now, wake = self.work_off(events, now, until)
        self.held.clear()
        if rest:
            self.held.put(rest)
        if now is None:
            self.now.clear()
        else:
            self.now.update(now)
        if wake is not None:
            self._wake(wake)
        frame = pd.DataFrame(out, columns=self.columns)
        for name, value in zip(self.keys, key, strict=True):
            frame.insert(0, name, value)
        yield frame

    def _wake(self, sec: int) -> None:
        self.handle.registerTimer(int(sec) * 1000)

    def close(self) -> None:
        pass


class Leases(Held):
    """The states of a task: what its log says, and what its lease's or its retention's end brings about."""

    fields, numbers = "sec long, id long, action string", "status string, attempts long, lease long, ended long"
    keys, columns = ("task",), ["sec", "status", "why", "attempts"]

    def __init__(self, lease: int):
        self.lease = lease

    def work_off(self, events, now, until):
        status, attempts, lease, ended = now or ("", 0, 0, 0)
        out, k = [], 0
        while True:
            due = lease if status == "in_progress" and lease else ended + RETENTION if ended else None
            if k < len(events) and events[k][0] <= until and (due is None or events[k][0] <= due):
                sec, _, action = events[k]
                k += 1
                if ended:  # what comes after the end changes nothing
                    continue
                status, attempts = BECOMES[action], attempts + (action == "claim")
                lease = sec + self.lease if status == "in_progress" else 0
                ended = sec if action in ENDS else 0
                out.append((sec, status, action, attempts))
            elif due is not None and due <= until:
                if ended:
                    out.append((due, "", "pruned", attempts))
                    rest = [e for e in events[k:] if e[0] > until]
                    return out, rest, None, min([e[0] for e in rest], default=None)
                status, lease = "ready", 0
                out.append((due, "ready", "lapsed", attempts))
            else:
                break
        rest = events[k:]
        due = [e[0] for e in rest] + ([lease] if status == "in_progress" and lease else []) + ([ended + RETENTION] if ended else [])
        return out, rest, (status, attempts, lease, ended), min(due, default=None)


class Changes(Held):
    """One change for each burst of changes of a path, once it has been quiet."""

    fields, numbers = "sec long, id long, change string", "burst long"
    keys, columns = ("path",), ["burst", "last", "change"]

    def __init__(self, quiet: int):
        self.quiet = quiet

    def work_off(self, events, now, until):
        burst, out, at = now[0] if now else 0, [], 0
        while at < len(events):
            end = at + 1
            while end < len(events) and events[end][0] - events[end - 1][0] < self.quiet:
                end += 1
            last = events[end - 1][0]
            if last + self.quiet > until:
                break
            change = ""
            for _, _, x in events[at:end]:
                change = FOLDED.get((change, x), x)
            burst, at = burst + 1, end
            if change:
                out.append((burst, last, change))
        rest = events[at:]
        return out, rest, (burst,), rest[-1][0] + self.quiet if rest else None


class Once(StatefulProcessor):
    """The first of each id and sender within a time to live, after which the state forgets it by itself."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id long", "sec long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            fresh = []
            for i, sec in zip(f["id"].tolist(), f["sec"].tolist(), strict=True):
                fresh.append(not self.seen.containsKey((i,)))
                if fresh[-1]:
                    self.seen.updateValue((i,), (sec,))
            yield f.loc[fresh, ["author", "id", "sec"]]

    def close(self) -> None:
        pass


def leases(log: DataFrame, lease: int, late: str = "1 hour") -> DataFrame:
    """Streaming form over (task, ts, sec, id, action): task, sec, status, why, attempts, a row for each change of a task's state.

    Claims and extensions hold for ``lease`` seconds, then the task is ready again; ended tasks are
    pruned (status "") after their retention; an id that comes again after that is a new task. Needs the
    RocksDB state store.
    """
    rows = log.withWatermark("ts", late).select("task", "ts", "sec", "id", "action")
    return rows.groupBy("task").transformWithStateInPandas(Leases(lease), "task string, sec long, status string, why string, attempts long", "Append", "EventTime")


def changes(events: DataFrame, quiet: int, late: str = "1 hour") -> DataFrame:
    """Streaming form of ``settle`` over (path, ts, sec, id, change): path, burst, last, change."""
    rows = events.withWatermark("ts", late).select("path", "ts", "sec", "id", "change")
    return rows.groupBy("path").transformWithStateInPandas(Changes(quiet), "path string, burst long, last long, change string", "Append", "EventTime")


def once(events: DataFrame, ttl_seconds: int) -> DataFrame:
    """Streaming form over (author, id, sec): each author's ids once within ``ttl_seconds`` of processing time."""
    return events.select("author", "id", "sec").groupBy("author").transformWithStateInPandas(Once(1000 * ttl_seconds), "author string, id long, sec long", "Append", "ProcessingTime")
