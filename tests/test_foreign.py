"""A data source over SQLite files: ranges, filters, offsets, as a batch and as a stream."""

import json
import sqlite3

import pytest

from weir.sources import foreign


@pytest.fixture
def db(spark, tmp_path):
    foreign.register(spark)
    path = str(tmp_path / "sessions.db")
    with sqlite3.connect(path) as c:
        c.execute('CREATE TABLE messages (id INTEGER PRIMARY KEY, session TEXT, seq INTEGER, role VARCHAR(9), "odd ""name" REAL, raw BLOB)')
    add(path, range(100))
    return path


def add(path, ids):
    with sqlite3.connect(path) as c:
        c.executemany("INSERT INTO messages VALUES (?, ?, ?, ?, ?, ?)", [(i + 1, f"s{i % 3}", i // 3, None if i % 10 == 0 else "user", i / 2, b"x") for i in ids])


def read(spark, path, **options):
    return spark.read.format("sqlite_table").options(path=path, table="messages", rows=30, **options).load()


def test_ranges_and_schema(spark, db):
    rows = read(spark, db)
    assert rows.dtypes == [("id", "bigint"), ("session", "string"), ("seq", "bigint"), ("role", "string"), ('odd "name', "double"), ("raw", "binary")]
    assert rows.rdd.getNumPartitions() == 4 and sorted(r.id for r in rows.collect()) == list(range(1, 101))
    assert bytes(rows.first().raw) == b"x"


def test_filters(spark, db):
    rows = read(spark, db, where=json.dumps([["session", "=", "s1"], ["seq", ">=", 20], ["id", "<", 90]]))
    assert sorted(r.id for r in rows.collect()) == [i + 1 for i in range(100) if i % 3 == 1 and i // 3 >= 20 and i < 89]
    assert rows.filter("seq > 25").count() == sum(i % 3 == 1 and i // 3 > 25 and i < 89 for i in range(100)) and rows.count() == 10
    assert read(spark, db, where=json.dumps([['odd "name', ">", 40.0]])).count() == sum(i / 2 > 40 for i in range(100))
    assert read(spark, db, where=json.dumps([["session", "=", "'; DROP TABLE messages"]])).count() == 0 and read(spark, db).count() == 100
    with pytest.raises(Exception, match="unknown operators"):
        read(spark, db, where=json.dumps([["id", "IN", 1]])).count()


def test_two_resumed_reads_equal_one(spark, db):
    first = read(spark, db, until=45).collect()
    add(db, range(100, 120))
    rest = read(spark, db, offset=45).collect()
    assert sorted(map(str, first + rest)) == sorted(map(str, read(spark, db).collect())) and len(first) == 45
    assert read(spark, db, offset=120).collect() == []


def test_stream_reads_what_is_appended_once(spark, db, tmp_path):
    def run():
        stream = spark.readStream.format("sqlite_table").options(path=db, table="messages", rows=30).load()
        q = stream.select("id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == list(range(1, 101))
    add(db, range(100, 150))
    assert run() == list(range(1, 151))


def test_offsets_and_models(spark):
    rows = spark.createDataFrame([("a", 0, 10, None), ("a", 1, 20, "m1"), ("a", 2, 30, "m2"), ("a", 3, 40, ""), ("b", 0, 5, "")], "session string, seq long, created_at long, model string")
    assert [tuple(r) for r in foreign.models(rows).collect()] == [("a", "m2")]
    got = foreign.from_offsets(rows, spark.createDataFrame([("a", 2), ("c", 1)], "session string, offset long")).collect()
    assert sorted((r.session, r.seq, r.next) for r in got) == [("a", 2, 4), ("a", 3, 4), ("b", 0, 1)]
