"""A registry of detectors: each takes logical tables and gives annotations (section, kind, why)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

COLUMNS = ("section", "kind", "why")
DETECTORS: dict[str, Callable[..., DataFrame]] = {}


def detector(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    DETECTORS[f.__name__] = f
    return f


def annotations(names: list[str], **tables: DataFrame) -> DataFrame:
    """What the named detectors find, each annotation once. A detector takes the tables that its parameters name."""
    found = [f(*(tables[n] for n in f.__code__.co_varnames[: f.__code__.co_argcount])).select(*COLUMNS) for f in map(DETECTORS.__getitem__, names)]
    return reduce(DataFrame.unionByName, found).distinct()
