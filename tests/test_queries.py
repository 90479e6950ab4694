"""Every query of the logical tables against its SQL, and the parts that SQL doesn't reach."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from weir import bindings, queries
from weir.sources import io
from weir.operators import code, collaboration, planning, search, texts
from weir.streaming import silence, traces, windows

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    got = [[plain(v) for v in r] for r in df.select(*cols).collect()]
    at = [want.columns.index(c) for c in cols]
    key = lambda r: [str(v) for v in r]
    assert sorted(got, key=key) == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=key)


def test_searches_check_their_arguments(spark, sf):
    t = {n: f(spark, sf) for n, f in bindings.TABLES.items()}
    files = [t[n] for n in ("symbols", "blobs", "file_revs", "refs")]
    edges = [t[n] for n in ("symbol_edges", "symbols", "file_revs", "refs")]
    for call in (
        lambda: search.search_commits(t["commits"]), lambda: search.search_diffs(t["diffs"], t["commits"], author="a"), lambda: search.search_symbols(*files), lambda: search.search_comments(t["comments"], *files[1:]),
        lambda: search.search_code(t["ledger"]), lambda: search.search_commits(t["commits"], ["a"], limit=0), lambda: search.search_commits(t["commits"], ["a"], regex="b"), lambda: search.search_commits(t["commits"], regex=""),
        lambda: search.callers(*edges, "f", depth=11), lambda: search.callees(*edges, "f", depth=0), lambda: search.callers(*edges, "f", confidence="sure"),
    ):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(TypeError):
        search.search_commits(t["commits"], ["a"], state="open")


def test_matches(spark):
    df = spark.createDataFrame([("A.b*c",), ("a.B",), ("xa.by",), (None,)], "s string")
    hit = lambda *a, **k: [r.s for r in df.filter(search.matches(F.col("s"), *a, **k)).collect()]
    assert hit("a.b") == ["A.b*c", "a.B", "xa.by"] and hit("a.b", case=True) == ["xa.by"] and hit("a?b") == ["a.B"] and hit("A*", case=True) == ["A.b*c"] and hit("*.by") == ["xa.by"]
    assert [r.s for r in df.filter(search.like("s", None, "by")).collect()] == ["A.b*c", "a.B"]  # null goes too


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "v": "a"}\nnot json\n{"id": 2}\n')
    rows = io.read_ndjson(spark, str(tmp_path / "a.jsonl"), "id long, v string")
    assert sorted(map(tuple, rows.collect())) == [(1, "a"), (2, None)]
    (tmp_path / "b.jsonl").write_text('{"id": null}\n\n{"v": "x"}\n{"id": "no"}\n')
    assert sorted(map(tuple, io.read_ndjson(spark, str(tmp_path / "b.jsonl"), "id long, v string").collect()), key=str) == [(None, "x"), (None, None)]
    (tmp_path / "facts").mkdir()
    for k, text in enumerate(('{"_meta": {"v": 2}}\n{"headline": "a", "who": "w"}\n\nbroken\n', '{"schema_version": "1", "recorded_at": "x"}\n{"content": "b"}\n', '{"headline": "c", "source_url": "u"}\n')):
        (tmp_path / "facts" / f"{k}.jsonl").write_text(text)
    facts = io.read_facts(spark, str(tmp_path / "facts"))
    assert sorted((r.headline, r.who, r.source_url) for r in facts.collect()) == [("a", "w", None), ("b", None, None), ("c", None, "u")]
    io.write_facts(facts, str(tmp_path / "again"))
    assert sorted(map(str, io.read_facts(spark, str(tmp_path / "again")).collect())) == sorted(map(str, facts.collect()))
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "id long, v string")
    assert sorted(map(tuple, io.insert_or_ignore(old, new, ["id"], ["v"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, io.upsert(old, io.latest(new, ["id"], ["v"]), ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "e")]
    files = spark.createDataFrame([("a", 1), ("b", 2)], "path string, mtime long")
    assert [r.path for r in io.changed(files, files.filter("path = 'a'")).collect()] == ["b"]
    assert io.changed(files, spark.createDataFrame([("a", 2), ("b", 2)], "path string, mtime long")).collect()[0].path == "a"


def test_line_is_found_in_the_text_itself(spark):
    docs = spark.createDataFrame([(1, "İ" * 14 + "Term here\nnext"), (2, "one\ntwo tERM\nterm"), (3, "nothing"), (4, None)], "id long, content string")
    assert {r.id: (r.line, r.snippet) for r in texts.located(docs, ["term"]).collect()} == {1: (1, "İ" * 14 + "Term here"), 2: (2, "two tERM")}
    assert {r.id for r in texts.excerpts(docs, "term").collect()} == {1, 2}


def test_innermost_and_parents_of_long_files(spark):
    symbols = spark.createDataFrame([(1, 7, 0, 10**6), (2, 7, 5, 40), (3, 7, 10, 20), (4, 7, 10, 20), (5, 7, 999_990, 999_999), (6, 8, 3, 3)], "id long, blob_id long, line int, end_line int")
    refs = spark.createDataFrame([(k, b, at) for k, (b, at) in enumerate([(7, 15), (7, 20), (7, 39), (7, 40), (7, 999_995), (8, 3), (9, 1)])], "id long, blob_id long, line int")
    assert [r.symbol_id for r in code.innermost(refs, symbols).orderBy("id").collect()] == [3, 2, 2, 1, 5, None, None]
    assert {r.id: r.parent_id for r in code.parents(symbols).collect()} == {1: None, 2: 1, 3: 2, 4: 2, 5: 1, 6: None}


def test_bridges_known_answer(spark):
    rows = [("a", "p1/x/1"), ("a", "p2/x/1"), ("a", "p3/x/1"), ("b", "p1/x/2"), ("b", "p2/x/2"), ("c", "p4/x/1"), ("c", "p5/x/1")]
    got = collaboration.bridges(spark.createDataFrame(rows, "author string, file string"))
    assert sorted(map(tuple, got.collect())) == [("a", "p1/x", "p3/x"), ("a", "p2/x", "p3/x")]


def test_patterns_are_checked():
    for bad in ('[{"id": "a", "reason": "r"}]', '[{"id": "a", "reason": "r", "path": "p", "regex": "x"}]'):
        with pytest.raises(ValueError):
            planning.load_patterns(bad)
    with pytest.raises(TypeError):
        planning.load_patterns('[{"id": "a", "reason": "r", "rejex": "x"}]')


def test_streams_equal_batch(spark, sf, tmp_path):
    events = bindings.murmurs(spark, sf).repartition(1)
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for k, f in enumerate((windows.tumbling, windows.settled, lambda e: windows.relayed(e, "u1").select("id", "file"))):
        q = f(stream).writeStream.format("memory").queryName(f"out{k}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        got, want = set(map(tuple, spark.table(f"out{k}").collect())), set(map(tuple, f(events).collect()))
        assert got <= want and len(got) > 0.9 * len(want)  # the last windows stay open


def test_silence_with_state(spark, sf, tmp_path):
    events = bindings.murmurs(spark, sf)
    first, last = events.selectExpr("min(sec)", "max(sec)").first()
    part = ((F.col("sec") - first) * 4 / (last - first + 1)).cast("int")
    late = F.when((F.col("id") % 10 == 0) & (part < 3), part + 1).otherwise(part)  # a tenth of the rows come a batch later
    for k in range(4):
        events.filter(late == k).orderBy(F.rand(k)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = silence.silences(stream, "click", 3600, f"{(last - first) // 2} seconds")
    q = out.writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    got, want = set(map(tuple, spark.table("silent").collect())), set(map(tuple, collaboration.silences(events, "click", 3600).collect()))
    middle = (first + last) // 2 - 2 * 3600  # what the last watermark has passed
    assert got <= want and {r for r in want if r[2] < middle} <= got


def test_silence_rule():
    events = [(0, 1, True), (5, 2, True), (30, 3, False), (40, 4, True), (45, 5, False), (80, 6, True)]
    assert silence.settled(events, 20, 100) == ([(2, 5), (6, 80)], [])
    assert silence.settled(events[::-1], 20, 60) == ([(2, 5)], [(45, 5, False), (80, 6, True)])


def test_trace_rule():
    spans = [(0, 1, False), (5, 2, True), (6, 3, False), (125, 4, False), (126, 5, False), (300, 6, True), (301, 7, True)]
    assert traces.step([], None, spans, 120) == ([(2, 2, 5), (6, 2, 300)], [], 420)
    first = traces.step([], None, spans[:4], 120)
    assert first == ([(2, 2, 5)], [], 125) and traces.step(first[1], first[2], spans[4:], 120) == ([(6, 2, 300)], [], 420)


def test_traces_with_state(spark, sf, tmp_path):
    own = bindings.murmurs(spark, sf).select(F.col("author").alias("trace"), F.col("id").alias("span"), "ts", "sec", (F.col("topic") == "purchase").alias("root"))
    first, last = own.selectExpr("min(sec)", "max(sec)").first()
    for k in range(3):
        own.filter(((F.col("sec") - first) * 3 / (last - first + 1)).cast("int") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = traces.assembled(stream, 7200, 40 * 86400).writeStream.format("memory").queryName("trees").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    got = {}
    for r in spark.table("trees").orderBy("sec").collect():
        got.setdefault(r.trace, (r.root, r.spans))
    want = {r.trace: (r.root, r.spans) for r in planning.assembled(own, 7200).collect()}
    assert got == want
