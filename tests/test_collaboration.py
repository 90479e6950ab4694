"""Pairs of authors against a plain count, and what is shuffled for them."""

import random
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest

from weir.operators import collaboration as C


def plain(rows):
    files = {}
    for file, author in rows:
        if file is not None and author is not None:
            files.setdefault(file, set()).add(author)
    return Counter(p for authors in files.values() for p in combinations(sorted(authors, key=str.encode), 2))


def test_author_pairs_equal_a_plain_count(spark):
    r = random.Random(3)
    names = [f"u{i}" for i in range(60)] + ["é", "Z", "\U0001f600", "￮", "", None]
    rows = [(r.choice(["", None, *map(str, range(40))]), r.choice(names)) for _ in range(1500)]
    got = C.author_pairs(spark.createDataFrame(rows, "file string, author string")).collect()
    assert {(x.author, x.other): x.files for x in got} == plain(rows) and len(got) == len(plain(rows))
    assert C.author_pairs(spark.createDataFrame([("f", "a"), ("g", "b")], "file string, author string")).collect() == []


@pytest.mark.parametrize("most", [1, 7, 50, 1 << 20])
@pytest.mark.parametrize("same", [False, True])
@pytest.mark.parametrize("authors", [12, 3000])  # the second leaves a table of all pairs mostly empty
def test_two_blocks_are_counted_in_pieces(monkeypatch, most, same, authors):
    monkeypatch.setattr(C, "PAIRS", most)
    r = random.Random(authors)
    lists = lambda: [sorted(r.sample(range(authors), r.randint(1, 9))) for _ in range(30)]
    left = lists()
    right = left if same else lists()
    names = [[f"{s}{i:04d}" for i in range(authors)] for s in "ab"]
    said = [{"left": [], "right": None, "names": names[0]}, *([] if same else [{"left": None, "right": None, "names": names[1]}])]
    kind = pa.schema([("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32())), ("names", pa.list_(pa.string()))])
    rows = pa.Table.from_pylist([*said, *({"left": x, "right": y, "names": None} for x, y in zip(left, right))], kind)
    out = [x for b in C._shared((pa.scalar(1), pa.scalar(1 if same else 2)), iter(rows.to_batches(max_chunksize=4))) for x in b.to_pylist()]
    want = Counter((names[0][a], names[0 if same else 1][b]) for x, y in zip(left, right) for a in x for b in y if not same or a < b)
    assert {(x["a"], x["b"]): x["files"] for x in out} == want and len(out) == len(want)


def test_pairs_of_a_file_are_not_shuffled(spark):
    """A file of 1,000 authors has 499,500 pairs."""
    sent = lambda: sum(s.shuffleWriteRecords() for s in stages())

    def stages():
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return [found.apply(k) for k in range(found.size())]

    rows = spark.range(1000).selectExpr("'f' as file", "concat('u', id) as author")
    before = sent()
    assert C.author_pairs(rows).count() == 499_500
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert sent() - before < 20_000
