"""The written full-text index against plain loops, and what its searches read."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weir.operators import inverted as I

TEXTS = [(1, "The cat sat on the mat, the end."), (2, "a CAT and a dog"), (3, None), (4, ""), (5, "dog dog dog the the the the"), (6, "cat_1 cat-2 the cat sat"), (7, "on the mat on the mat"), (8, "x " * 5000 + "cat")]
TEXTS += [(100 + i, f"common word{i % 7} the number {i}") for i in range(60)]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(i, t, "extra") for i, t in TEXTS], "id long, content string, term string")
    return I.build(docs, buckets=16, spread=3)


def words(t):
    return re.findall("[a-z0-9_]+", (t or "").lower())


def plain(terms, every=False):
    own = {i: words(t) for i, t in TEXTS}
    mean = sum(map(len, own.values())) / len(own)
    df = Counter(t for w in own.values() for t in set(w))
    out = []
    for i, w in own.items():
        tf = Counter(w)
        met = [t for t in set(terms) if tf[t]]
        if met and (not every or len(met) == len(set(terms))):
            s = sum(math.log(1 + (len(own) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in met)
            out.append((round(s, 4), i))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def found(df):
    return [(r.score, r.id) for r in df.collect()]


@pytest.mark.parametrize(("terms", "every"), [(["cat"], False), (["the", "dog"], False), (["the", "cat", "the"], True), (["absent"], False), (["common", "word3", "the"], True)])
def test_ranked(index, terms, every):
    assert found(I.ranked(index, terms, None, every)) == plain(terms, every)
    assert found(I.ranked(index, terms, 3, every)) == plain(terms, every)[:3]


@pytest.mark.parametrize("said", ["the cat", "on the mat", "the the", "dog dog dog", "cat", "The, END", "sat the", "word3 the number"])
def test_phrase(index, said):
    want = {}
    p = words(said)
    for i, t in TEXTS:
        w = words(t)
        at = [k + 1 for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        if at:
            want[i] = (len(at), at[0])
    assert {r.id: (r.hits, r.first) for r in I.phrase(index, said).collect()} == want


def test_hits_and_filters(spark, index):
    rows = spark.createDataFrame([(i, f"n{i}") for i in (1, 2, 5, 6, 999)] + [(1, "again")], "id long, name string")
    assert sorted((r.id, r.name) for r in I.hits(index, "cat", rows).collect()) == [(1, "again"), (1, "n1"), (2, "n2"), (6, "n6")]
    assert found(I.filtered(index, "cat the", rows, 2)) == [x for x in plain(["cat", "the"]) if x[1] in (1, 2, 5, 6)][:2]
    with pytest.raises(ValueError):
        I.ranked(index, "...")


def test_search_reads_its_partitions_only(spark, index):
    plan = I.ranked(index, ["cat", "dog"])._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet.*", plan)
    assert scans and all("/postings/" in f for f in I.ranked(index, ["cat", "dog"]).inputFiles())  # no text is read
    assert all(re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN \(|= )", s) and re.search(r"PushedFilters: \[[^\]]*In\(term", s) for s in scans)
    assert all("positions" not in s.split("ReadSchema")[1] for s in scans)


def test_index_can_be_opened_again(spark, index):
    again = I.opened(spark, index.path)
    assert (again.texts, again.mean, again.buckets) == (index.texts, index.mean, 16) and index.texts == len(TEXTS)
    assert found(I.ranked(again, ["the"], 5)) == plain(["the"])[:5]


def test_hot_words_are_spread(spark):
    """The postings of a word of all texts come in several files, each for some of the ids."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        made = I.build(spark.range(200).selectExpr("id", "concat('the ', id) as content"), buckets=4, spread=8)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert made.postings(["the"]).select(F.input_file_name()).distinct().count() > 3


def test_segments_and_removals(spark):
    """After adding, removing and adding again an index answers like one that is built of what is left."""
    frame = lambda rows: spark.createDataFrame(rows, "id long, content string")
    made = I.build(frame(TEXTS[:30]), buckets=8)
    made = I.added(made, frame(TEXTS[30:]))
    assert (made.texts, made.segments) == (len(TEXTS), [0, 1]) and found(I.ranked(made, "the cat", None)) == plain(["the", "cat"])
    made = I.removed(made, frame([(1, ""), (5, ""), (103, ""), (9999, "")]))
    made = I.added(made, frame([(5, "the new words of five"), (300, "cat cat")]))
    left = [(i, t) for i, t in TEXTS if i not in (1, 5, 103)] + [(5, "the new words of five"), (300, "cat cat")]
    anew = I.build(frame(left), buckets=8)
    assert (made.texts, made.mean) == (anew.texts, anew.mean)
    for said in ("the cat", "number", "five dog"):
        assert found(I.ranked(made, said, None)) == found(I.ranked(anew, said, None)) != []
    assert sorted(map(tuple, I.phrase(made, "the new").collect())) == [(5, 1, 1)] and I.phrase(made, "the mat the end").collect() == []
    again = I.removed(I.removed(made, frame([(5, "")])), frame([(5, "")]))
    assert again.texts == made.texts - 1 and 5 not in {r.id for r in I.ranked(again, "the five", None).collect()}


def test_segment_that_failed_is_not_seen(spark):
    import shutil

    frame = lambda rows: spark.createDataFrame(rows, "id long, content string")
    made = I.build(frame([(1, "one cat")]), buckets=4)
    more = I.added(made, frame([(2, "a cat")]))
    shutil.rmtree(made.path.removeprefix("file:") + "/figures/segment=1")  # lost before its figures were written
    back = I.opened(spark, made.path)
    assert back.texts == 1 and [r.id for r in I.ranked(back, "cat").collect()] == [1]
    assert [r.id for r in I.ranked(I.added(back, frame([(3, "cat cat")])), "cat").collect()] == [3, 1] and more.texts == 2


def test_index_of_nothing(spark):
    empty = I.build(spark.createDataFrame([], "id long, content string"))
    assert empty.texts == 0 and I.ranked(empty, "a").collect() == [] and I.phrase(empty, "a b").collect() == []
