"""Walks over histories, overlays, and text functions on groups of paths and marked passages."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from weir.functions import text as T
from weir.operators import versions
from weir.tables import numbered


def walked(spark, edges, tips, known, depth):
    frame = lambda rows: spark.createDataFrame([(x,) for x in rows], "commit_id long")
    got = versions.new_commits(spark.createDataFrame(edges, "commit_id long, parent_id long"), frame(tips), frame(known), depth)
    return {r.commit_id: (r.near, r.far, r.cut, r.number) for r in got.collect()}


def test_diamond_of_unequal_arms(spark):
    """6 merges 5 and 1; the long arm 5-4-3-1 decides where 1 comes."""
    edges = [(6, 5), (6, 1), (5, 4), (4, 3), (3, 1), (1, 0)]
    got = walked(spark, edges, [6], [0], 20)
    assert {c: r[:3] for c, r in got.items()} == {6: (0, 0, False), 5: (1, 1, False), 4: (2, 2, False), 3: (3, 3, False), 1: (1, 4, False)}
    assert sorted(got, key=lambda c: got[c][3]) == [1, 3, 4, 5, 6]


def test_known_commits_and_depth_end_the_walk(spark):
    edges = [(9, 8), (8, 7), (7, 6), (6, 5), (9, 4), (4, 3), (3, 2)]
    assert set(walked(spark, edges, [9], [7, 3], 20)) == {9, 8, 4}
    got = walked(spark, edges, [9], [], 2)
    assert set(got) == {9, 8, 4, 7, 3} and {c for c, r in got.items() if r[2]} == {7, 3}
    assert walked(spark, edges, [7], [7], 5) == {} and walked(spark, edges, [], [], 5) == {}


def test_walk_against_plain_loops(spark):
    rng = random.Random(8)
    edges = sorted({(c, rng.randrange(max(0, c - 8), c)) for c in range(1, 80) for _ in range(rng.choice([1, 1, 2]))})
    known, tips = set(range(15)) | {33}, [79, 70, 40]
    near, far, front = {}, {}, {t for t in tips if t not in known}
    for step in range(100):
        for c in front:
            near.setdefault(c, step)
            far[c] = step
        front = {p for c, p in edges if c in front and p not in known}
    got = walked(spark, edges, tips, known, 100)
    assert {c: r[:2] for c, r in got.items()} == {c: (near[c], far[c]) for c in far}
    assert all(got[p][3] < got[c][3] for c, p in edges if c in got and p in got)  # parents first
    assert sorted(r[3] for r in got.values()) == list(range(1, len(got) + 1))


def test_numbered(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 as k")
    got = numbered(rows, F.desc("k"), F.col("id")).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.number)] == sorted(range(1000), key=lambda i: (-(i % 7), i)) and {r.number for r in got} == set(range(1, 1001))
    assert numbered(rows.limit(0), "id").collect() == []


def test_overlays_in_their_order(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "x"), (None, 1, "x")], "path string, n long, v string")
    one = spark.createDataFrame([("a", 7, "one"), ("b", 7, "one"), ("new", 1, "one")], "path string, n long, v string")
    two = spark.createDataFrame([("b", True), ("c", True), ("never", True)], "path string, deleted boolean")
    three = spark.createDataFrame([("c", 8), ("c", 9)], "path string, n long")
    rows = lambda *layers: sorted((tuple(r) for r in versions.overlaid(base, list(layers)).collect()), key=str)
    assert rows(one, two, three) == sorted([("a", 7, "one"), ("new", 1, "one"), ("c", 8, None), ("c", 9, None), ("d", 1, "x"), (None, 1, "x")], key=str)
    assert rows(three, two, one) == sorted([("a", 7, "one"), ("b", 7, "one"), ("new", 1, "one"), ("d", 1, "x"), (None, 1, "x")], key=str)
    assert rows() == sorted(map(tuple, base.collect()), key=str)


@pytest.mark.parametrize(
    ("paths", "want"),
    [
        (["a/b/c.go", "a/b/d.go"], "a/b/"), (["a/b/c.go", "a/bc/d.go"], "a/"), (["a/b.go"], "a/b.go"), (["x.go", "a/b.go"], "these files"), (["x.go", "y.go"], "these files"), (["a/b/c/d", "a/b/e", "a/b/c/f"], "a/b/"), (["/r/a", "/r/b"], "/r/"), (["b/x", "a/x"], "these files"), ([None], "these files"),
        (["a-b/x/1", "a/x/1", "a/x/2"], "these files"),
    ],
)
def test_common_area(spark, paths, want):
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert df.agg(T.common_area("p").alias("a")).first().a == want


def test_common_area_against_commonpath(spark):
    rng = random.Random(2)
    rows = [(g, "/".join(["r", *(rng.choice("ab") for _ in range(rng.randint(0, 4))), f"f{i}"])) for g in range(150) for i in range(rng.randint(2, 4))]
    got = {r.g: r.a for r in spark.createDataFrame(rows, "g long, p string").groupBy("g").agg(T.common_area("p").alias("a")).collect()}
    for g in range(150):
        assert got[g] == os.path.commonpath([os.path.dirname(p) for k, p in rows if k == g]) + "/"


def test_passages(spark):
    said = "the <t>the cat. And the dog</t> the <t>the one</t><t></t> <t>open the"
    row = spark.createDataFrame([(said,), (None,)], "c string").select(*(T.thinned(F.col("c"), "t", m, ("the", "and"), {"cat": "c"}).alias(m) for m in ("words", "first", "all"))).collect()
    assert tuple(row[0]) == ("the <t>c. dog</t> the <t>one</t><t></t> <t>open the", "the <t>the cat. ...[reasoning elided]</t> the <t>one</t><t></t> <t>open the", "the  the  <t>open the")
    with pytest.raises(ValueError):
        T.thinned(F.col("c"), "t", "none")


def test_passages_that_never_end_take_linear_time(spark):
    began = time.time()
    for text in ("<t>" * 300_000, "<t>a</t>" * 100_000 + "<t>" * 100_000, "</t>" * 200_000):
        got = spark.createDataFrame([(text,)], "c string").select(T.thinned(F.col("c"), "t", "all").alias("c")).first().c
        assert got == text.replace("<t>a</t>", "")
    assert time.time() - began < 60
