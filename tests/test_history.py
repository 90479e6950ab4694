"""Matching in time, excerpts and calendar layers against plain versions."""

import random

from weir import queries
from weir.operators import history, texts


def test_greedy_match(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.randrange(400), rng.random() < 0.5) for k in "abc" for i in range({"a": 0, "b": 60, "c": 90}[k])]
    frame = lambda task: spark.createDataFrame([r[:3] for r in rows if r[3] == task], "key string, id long, sec long")
    want = set()
    for key in "abc":
        ends = sorted((s, i) for k, i, s, task in rows if k == key and not task)
        for s, i in sorted((s, i) for k, i, s, task in rows if k == key and task):
            free = next((e for e in ends if e[0] > s - 30), None)
            if free:
                ends.remove(free)
            want.add((key, i, free and free[1]))
    got = list(map(tuple, history.greedy_match(frame(True), frame(False), 30).collect()))
    assert set(got) == want and len(got) == len(want) and any(m is None for _, _, m in want)


def test_excerpt(spark):
    text = "zero " * 30 + "Über die needle im Heu " + "last " * 40
    docs = spark.createDataFrame([(1, text), (2, "a needle"), (3, "a"), (4, None), (5, "needle " + "x" * 500)], "id long, content string")
    got = {r.id: r.snippet for r in texts.excerpts(docs, "NEEDLE", 60).collect()}
    assert got[1].startswith("...") and got[1].endswith("...") and "needle" in got[1] and set(got[1].strip(".").split()) <= set(text.split())
    assert got[2] == "a needle" and got[5] == "needle..." and got.keys() == {1, 2, 5}


def test_excerpts_of_all(spark, sf):
    got = {r.id: r.snippet for r in queries.QUERIES["f4_excerpts"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got.keys() == {r.doc_id for r in docs if r.text and "that" in r.text.lower()}
    for r in docs:
        if r.doc_id in got:
            assert "that" in got[r.doc_id].lower() and got[r.doc_id].strip(".") in " ".join(r.text.split())


def test_layer():
    day, start = 86400, 1704067200  # 2024-01-01, a Monday
    assert history.layer(start, start + 31 * day - 1) == "month" and history.layer(start + day, start + 58 * day) == "week"
    assert history.layer(start + day, start + 60 * day - 1) == "month"
    assert history.layer(start, start + 7 * day - 1) == "week" and history.layer(start + day, start + 7 * day) == "day"
