"""Streams with state and timers against the batch forms, tails that are restarted, and written tables."""

import random
import time

import pytest
from pyspark.sql import functions as F

from weir.operators import code, queue
from weir.sources import sinks, tail
from weir.streaming import processors

DAY = 86400


def run(stream, name, folder, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return [tuple(r) for r in stream.sparkSession.table(name).collect()]


def in_batches(spark, rows, schema, path, late=()):
    """Writes rows (with sec) as files in order of time; rows whose index is in ``late`` come a file later. Returns the stream over them, a file a batch."""
    rows = sorted(rows, key=lambda r: r[1])
    n = max(1, -(-len(rows) // 4))
    at = [min(3, i // n + (i in late)) for i in range(len(rows))]
    for k in range(4):
        own = [r for r, b in zip(rows, at, strict=True) if b == k]
        random.Random(k).shuffle(own)
        spark.createDataFrame(own, schema).withColumn("ts", F.timestamp_seconds("sec")).coalesce(1).write.mode("append").parquet(str(path))
    full = spark.read.parquet(str(path)).schema
    return spark.readStream.schema(full).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_leases_equal_batch(spark, tmp_path):
    rng = random.Random(3)
    actions = ["add", "claim", "extend", "claim", "extend", "complete", "cancel"]
    rows = [(f"t{rng.randrange(12)}", rng.randrange(40 * DAY), i, rng.choices(actions, [3, 4, 4, 4, 4, 1, 1])[0]) for i in range(400)]
    first = {t: min((r[1] for r in rows if r[0] == t and r[3] in processors.ENDS), default=60 * DAY) for t in {r[0] for r in rows}}
    rows = [r for r in rows if r[1] <= first[r[0]] + 3000]  # after that the task is gone
    rows += [(t, sec + 10, 500 + k, "extend") for k, (t, sec) in enumerate(first.items()) if sec < 60 * DAY]
    rows += [("end", 60 * DAY, 1000, "add")]  # moves the watermark on
    schema = "task string, sec long, id long, action string"
    ordered = sorted(rows, key=lambda r: r[1])
    late = {i for i in range(0, 280, 9)}
    stream = in_batches(spark, rows, schema, tmp_path / "in", late)
    delay = 15 * DAY  # all late rows are within it
    got = run(processors.leases(stream, 2 * DAY, f"{delay} seconds"), "leases", tmp_path / "c")
    until = 60 * DAY - delay
    batch = queue.lease_log(spark.createDataFrame(ordered, schema), 2 * DAY, until)
    want = [tuple(r) for r in batch.collect()]
    assert sorted(got) == sorted(want) and {"lapsed", "pruned"} <= {r[3] for r in got} and len(got) > 60


def test_rows_beyond_the_watermark_are_dropped(spark, tmp_path):
    schema = "task string, sec long, id long, action string"
    rows = [("a", 1 * DAY, 1, "add"), ("a", 2 * DAY, 2, "claim"), ("z", 30 * DAY, 3, "add"), ("z", 31 * DAY, 4, "add"), ("z", 60 * DAY, 5, "add"), ("z", 61 * DAY, 6, "add")]
    for k, own in enumerate([rows[:2], rows[2:4], [("a", 3 * DAY, 9, "complete")], rows[4:]]):
        spark.createDataFrame(own, schema).withColumn("ts", F.timestamp_seconds("sec")).coalesce(1).write.parquet(str(tmp_path / f"in/k={k}"))
    full = spark.read.parquet(str(tmp_path / "in/k=0")).schema
    stream = spark.readStream.schema(full).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/*"))
    got = sorted(r for r in run(processors.leases(stream, DAY, "1 hour"), "dropped", tmp_path / "c") if r[0] == "a")
    assert got == [("a", DAY, "ready", "add", 0), ("a", 2 * DAY, "in_progress", "claim", 1), ("a", 3 * DAY, "ready", "lapsed", 1)]


def test_work_off_by_hand():
    lease = processors.Leases(100)
    out, rest, now, wake = lease.work_off([(10, 1, "add"), (20, 2, "claim"), (110, 3, "extend"), (300, 4, "complete"), (310, 5, "claim")], None, 305)
    assert out == [(10, "ready", "add", 0), (20, "in_progress", "claim", 1), (110, "in_progress", "extend", 1), (210, "ready", "lapsed", 1), (300, "completed", "complete", 1)]
    assert rest == [(310, 5, "claim")] and now == ("completed", 1, 0, 300) and wake == 310
    out, rest, now, wake = lease.work_off(rest, now, 5000)
    assert out == [(3900, "", "pruned", 1)] and rest == [] and now is None and wake is None


def test_changes_equal_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"p{rng.randrange(15)}", rng.randrange(3000), i, rng.choice(["created", "deleted", "modified", "renamed"])) for i in range(600)] + [("end", 9000, 10_000, "created")]
    schema = "path string, sec long, id long, change string"
    stream = in_batches(spark, rows, schema, tmp_path / "in", set(range(0, 430, 7)))
    got = run(processors.changes(stream, 20, "2000 seconds"), "changes", tmp_path / "c")
    want = [tuple(r) for r in code.settle(spark.createDataFrame(rows, schema), 20).select("path", "burst", "last", "change").collect() if r.path != "end"]
    assert sorted(got) == sorted(want) and len(want) > 100
    folds = {("created", "deleted"): "", ("created", "modified"): "created", ("deleted", "created"): "modified", ("renamed", "created"): "modified", ("modified", "deleted"): "deleted"}
    for (a, b), c in folds.items():
        found = processors.Changes(10).work_off([(1, 1, a), (2, 2, b)], None, 100)[0]
        assert found == ([(1, 2, c)] if c else [])


def test_once_within_its_time(spark, tmp_path):
    schema = "author string, sec long, id long"
    rows = [("a", 1, 1), ("a", 2, 2), ("b", 3, 1), ("a", 4, 1), ("a", 5, 3), ("b", 6, 1), ("b", 7, 2), ("a", 8, 2)]
    stream = in_batches(spark, rows, schema, tmp_path / "in")
    # In processing time a stream has no end of its own.
    q = processors.once(stream, 3600).writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        began = time.time()
        while sum(p["numInputRows"] for p in q.recentProgress) < len(rows) and time.time() - began < 90:
            time.sleep(0.5)
        got = [tuple(r) for r in spark.table("once").collect()]
    finally:
        q.stop()
    assert sorted((a, i) for a, i, _ in got) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)]


# Tail ----------------------------------------------------------------------------------------------
def test_tail_is_restarted_without_loss_or_repeat(spark, tmp_path):
    schema = "session long, seq long, said string"
    entries = [(s, k, f"{s}-{k}") for s in range(5) for k in range(20)]
    grown = [[e for e in entries if e[1] < 5], [e for e in entries if e[1] < 9 and e[0] < 3], [e for e in entries if e[1] < 20]]  # each file begins at the start again
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def add(k):
        spark.createDataFrame(grown[k] * 2, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def fail(batch):
        raise RuntimeError("lost between entries and offsets")

    add(0)
    assert tail.follow(stream(), path, checkpoint).awaitTermination(120)
    add(1)
    with pytest.raises(Exception, match="lost between"):
        tail.follow(stream(), path, checkpoint, fail).awaitTermination(120)
    assert tail.followed(spark, path, schema).count() == 25  # the batch that failed isn't seen
    assert sorted(map(tuple, tail.offsets(spark, path).collect())) == [(s, 5, 1) for s in range(5)]
    add(2)
    assert tail.follow(stream(), path, checkpoint).awaitTermination(120)
    got = sorted(map(tuple, tail.followed(spark, path, schema).collect()))
    assert [g[:3] for g in got] == sorted(entries)
    assert {(s, seq): push for s, seq, _, push in got} == {(s, k): 1 if k < 5 else (2 if s >= 3 or k < 9 else 3) for s, k, _ in entries}
    assert sorted(map(tuple, tail.offsets(spark, path).collect())) == [(s, 20, 3 if s < 3 else 2) for s in range(5)]
    assert tail.followed(spark, str(tmp_path / "nothing"), schema).collect() == []


# Written tables ------------------------------------------------------------------------------------
def test_second_load_rewrites_its_days_only(spark, tmp_path):
    import glob
    import os

    path = str(tmp_path / "prs")
    sinks.write_by_date(spark.createDataFrame([(i, i * DAY // 2, "old") for i in range(10)], "id long, created_at long, v string"), path)
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}
    sinks.write_by_date(spark.createDataFrame([(100, DAY, "new"), (101, 9 * DAY, "new")], "id long, created_at long, v string"), path)
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}
    gone = {f.split("day=")[1][:10] for f in before.keys() - after.keys()}
    assert gone == {"1970-01-02"} and all(after[f] == t for f, t in before.items() if f in after)
    got = sorted((r.id, r.v) for r in spark.read.parquet(path).collect())
    assert got == sorted([(i, "old") for i in range(10) if i not in (2, 3)] + [(100, "new"), (101, "new")])


def test_bucketed_tables_are_joined_without_a_shuffle(spark, tmp_path):
    symbols = spark.range(4000).selectExpr("id", "id % 50 as blob_id", "concat('f', id % 7) as name", "cast(id % 90 as int) as line")
    refs = spark.range(3000).selectExpr("id", "id % 50 as blob_id", "concat('f', id % 9) as ref_name", "cast(id % 90 as int) as line")
    r = sinks.write_bucketed(refs, "weir_test_refs", str(tmp_path / "refs"), buckets=8)
    s = sinks.write_bucketed(symbols, "weir_test_symbols", str(tmp_path / "symbols"), buckets=8)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found, plain = code.resolve(r, s), code.resolve(refs, symbols)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
        for t in ("refs", "symbols"):
            spark.sql(f"DROP TABLE IF EXISTS weir_test_{t}")
