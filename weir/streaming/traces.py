"""Trace assembly with state: spans wait for the root of their trace, which then gives the tree.

What comes within ``late`` seconds of a root is dropped, what comes later waits for another root. A trace
without one keeps its spans until it has been silent for ``idle`` seconds of event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def step(held: list[int], closed: int | None, spans: list[tuple[int, int, bool]], late: int) -> tuple[list[tuple[int, int, int]], list[int], int | None]:
    """(trees as (root, spans, sec), spans that wait, until when spans are dropped) after more spans (sec, span, root) in order."""
    trees = []
    for sec, span, root in spans:
        if closed is not None and sec <= closed:
            continue
        closed = None
        held = [*held, span]
        if root:
            trees.append((span, len(held), sec))
            held, closed = [], sec + late
    return trees, held, closed


def assembled(events: DataFrame, late: int = 120, idle: int = 86400, delay: str = "1 hour") -> DataFrame:
    """Streaming form over (trace, span, ts, sec, root): trace, root, spans, sec of each tree."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, closed = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        rows = sorted((int(s), int(i), bool(r)) for b in batches for s, i, r in zip(b["sec"], b["span"], b["root"], strict=True))
        trees, held, closed = step(held, closed, rows, late)
        state.update((held, closed))
        last = max([state.getCurrentWatermarkMs() // 1000, *(s for s, _, _ in rows)])
        state.setTimeoutTimestamp((last + max(idle, late)) * 1000)
        if trees:
            yield pd.DataFrame({"trace": key[0], "root": [t[0] for t in trees], "spans": [t[1] for t in trees], "sec": [t[2] for t in trees]})

    rows = events.withWatermark("ts", delay).select("trace", "span", "ts", "sec", "root")
    return rows.groupBy("trace").applyInPandasWithState(run, "trace string, root long, spans long, sec long", "held array<long>, closed long", "append", GroupStateTimeout.EventTimeTimeout)
