"""Sessions of other tools: a data source over SQLite files that splits into ranges, takes filters and resumes at offsets.

``register(spark)`` makes it known as ``sqlite_table``. Options: path (a file that all workers see), table,
rows (of a partition), offset and until (bounds of rowid, the first excluded) to resume, and where, a list
[[column, operator, value], ...] in JSON that the database applies. (Filters that Spark pushes down are
not taken: Spark keeps them with the source, and the next query on the same DataFrame would have them
too.) As a stream, its offset is the largest
rowid so far, so rows that are appended come once each. The schema is the table's, in Spark's types.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Rows of a partition, unless the option ``rows`` says otherwise.
ROWS = 100_000
OPERATORS = ("=", "<>", "<", "<=", ">", ">=")


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _spark_type(declared: str) -> str:
    """By SQLite's own rules of affinity."""
    kind = declared.upper()
    for part, found in (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double")):
        if part in kind:
            return found
    return "string"


@dataclass
class Range(InputPartition):
    """Rows with rowid over ``low`` and up to ``high``."""

    low: int
    high: int


class _Table:
    def __init__(self, options: dict, schema=None):
        self.path, self.table, self.rows = options["path"], options["table"], int(options.get("rows", ROWS))
        self.options, self.names = options, [f.name for f in schema.fields] if schema is not None else []
        self.where = json.loads(options.get("where", "[]"))
        if wrong := [op for _, op, _ in self.where if op not in OPERATORS]:
            raise ValueError(f"unknown operators {wrong}")

    def connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def columns(self) -> list[tuple[str, str]]:
        with self.connect() as db:
            return [(r[1], r[2]) for r in db.execute(f"PRAGMA table_info({_quoted(self.table)})")]

    def last(self) -> int:
        with self.connect() as db:
            return db.execute(f"SELECT coalesce(max(rowid), 0) FROM {_quoted(self.table)}").fetchone()[0]

    def ranges(self, low: int, high: int) -> list[Range]:
        return [Range(k, min(k + self.rows, high)) for k in range(low, high, self.rows)]

    def select(self, part: Range) -> Iterator[tuple]:
        """Rows of a range, a cursor's worth at a time."""
        terms = ["rowid > ?", "rowid <= ?", *(f"{_quoted(c)} {op} ?" for c, op, _ in self.where)]
        values = [part.low, part.high, *(v for _, _, v in self.where)]
        db = self.connect()
        try:
            yield from db.execute(f"SELECT {', '.join(map(_quoted, self.names))} FROM {_quoted(self.table)} WHERE {' AND '.join(terms)} ORDER BY rowid", values)
        finally:
            db.close()


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return ", ".join(f"`{name}` {_spark_type(kind)}" for name, kind in _Table(self.options).columns())

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(_Table(self.options, schema))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SqliteStream(_Table(self.options, schema))


class SqliteReader(DataSourceReader):
    def __init__(self, table: _Table):
        self.table = table

    def partitions(self) -> list[Range]:
        low = int(self.table.options.get("offset", 0))
        high = int(self.table.options.get("until", self.table.last()))
        return self.table.ranges(low, high) or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        yield from self.table.select(partition)


class SqliteStream(DataSourceStreamReader):
    def __init__(self, table: _Table):
        self.table = table

    def initialOffset(self) -> dict:
        return {"rowid": int(self.table.options.get("offset", 0))}

    def latestOffset(self) -> dict:
        return {"rowid": self.table.last()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.table.ranges(start["rowid"], end["rowid"]) or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        yield from self.table.select(partition)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteTable)


def from_offsets(messages: DataFrame, offsets: DataFrame) -> DataFrame:
    """What sessions (session, seq from 0, ...) have from their offsets (session, offset) on; all of those that have none. With ``next``, their offsets after that."""
    sizes = messages.groupBy("session").agg((F.max("seq") + 1).alias("next"))
    return messages.join(offsets, "session", "left").filter(F.col("seq") >= F.coalesce("offset", F.lit(0))).drop("offset").join(sizes, "session")


def models(messages: DataFrame) -> DataFrame:
    """session, model: the latest model that a message of the session names."""
    named = messages.filter(F.col("model").isNotNull() & (F.col("model") != ""))
    return named.groupBy("session").agg(F.max_by("model", F.struct("created_at", "seq")).alias("model"))
