"""Silence detector with state: a match counts once its author has been silent for ``quiet`` seconds after it.

Events are kept until the watermark has passed them by ``quiet``; then all that could have come after
them is known, whatever the order of arrival. So the state of an author holds what arrives within the
lateness and ``quiet``. A later match takes an earlier one's place, any other event revokes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def settled(events: list[tuple[int, int, bool]], quiet: int, until: float) -> tuple[list[tuple[int, int]], list[tuple[int, int, bool]]]:
    """(confirmed (id, sec), kept events) of events (sec, id, match) when everything up to ``until`` is known."""
    events = sorted(events)
    done = [e for e in events if e[0] + quiet <= until]
    after = [e[0] for e in events[1:]] + [None]
    found = [(i, s) for (s, i, match), nxt in zip(done, after, strict=False) if match and (nxt is None or nxt - s >= quiet)]
    return found, events[len(done) :]


def silences(events: DataFrame, topic: str, quiet: int, late: str = "1 hour") -> DataFrame:
    """Streaming form over (author, id, ts, sec, topic): author, id, sec of the confirmed matches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for b in batches:
            held += zip(b["sec"].tolist(), b["id"].tolist(), (b["topic"] == topic).tolist(), strict=True)
        found, kept = settled(held, quiet, state.getCurrentWatermarkMs() / 1000)
        if kept:
            state.update(tuple(list(c) for c in zip(*kept, strict=True)))
            state.setTimeoutTimestamp((kept[0][0] + quiet) * 1000)
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame({"author": key[0], "id": [i for i, _ in found], "sec": [s for _, s in found]})

    rows = events.withWatermark("ts", late).select("author", "id", "ts", "sec", F.coalesce("topic", F.lit("")).alias("topic"))
    return rows.groupBy("author").applyInPandasWithState(run, "author string, id long, sec long", "secs array<long>, ids array<long>, hits array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)
