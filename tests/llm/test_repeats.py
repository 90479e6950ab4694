"""Rows that are repeated very often, hostile texts, and plain versions of the packer and the split search."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.llm import components, exact_dedup, jaccard_join, language, lm_score, packing, quality, url_filter


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def near(k):
    """Two similar texts."""
    words = [f"w{k}x{i}" for i in range(60)]
    return " ".join(words), " ".join([*words[:-1], "other"])


def test_repeats_of_near_copies_cost_no_pairs(spark, make, monkeypatch):
    a, b = near(1)
    docs = make([(i % 2, (a, b)[i % 2]) for i in range(10_000)] + [(2, near(2)[0]), (3, near(2)[1])]).repartition(8)
    seen, own = [], jaccard_join._overlaps

    def overlaps(pairs, sets, *more):
        first = sets.filter("frag = 0").groupBy("cls").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        seen.append((first, sets.count()))
        return own(pairs, sets, *more)

    monkeypatch.setattr(jaccard_join, "_overlaps", overlaps)
    got = Counter(rows(jaccard_join.groups(docs, 5, 80), "doc_id", "component_id"))
    assert got == {(0, 0): 5000, (1, 0): 5000, (2, 2): 1, (3, 2): 1}
    assert all((first or 0) <= 8 and total <= 4 * 8 * jaccard_join.FRAGMENTS for first, total in seen)  # a class at most once in each task
    assert sorted(r.doc_id for r in jaccard_join.keep_one(docs, 5, 80).collect()) == [0, 2]


def test_near_copies_in_small_closures(spark, sf, monkeypatch):
    """No Bloom filter of Spark's goes along in the closures, and no plan holds all that is compared."""
    plans, own = [], jaccard_join.materialise

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return own(df)

    for module in (jaccard_join, components):
        monkeypatch.setattr(module, "materialise", planned)
    jaccard_join.keep_one(spark.read.parquet(f"{sf}/documents.parquet"), 5, 80)
    assert len(plans) > 10
    assert not [p for p in plans if "might_contain" in p]
    assert max(p.count("Exchange ") for p in plans) < 30


def test_long_lists_of_hubs_in_parts(make, monkeypatch):
    """Texts that only share a passage, so that one list has many hubs; the parts give the groups that the whole gives."""
    passage = " ".join(f"p{i}" for i in range(60))
    docs = make([(i, f"{passage} {' '.join(f'u{i}x{j}' for j in range(9 + i % 3))}") for i in range(60)] + [(100 + i, near(3)[i]) for i in range(2)])
    whole = sorted(rows(jaccard_join.groups(docs, 5, 70)))
    monkeypatch.setattr(jaccard_join, "LONG", 2)
    monkeypatch.setattr(jaccard_join, "HOT_GROUPS", 100_000)
    assert sorted(rows(jaccard_join.groups(docs, 5, 70))) == whole


def test_quality_sample_is_bounded_by_rows(spark, make, monkeypatch):
    held = []
    monkeypatch.setattr(quality, "grow", lambda x, y, *a: held.append(x.shape) or quality.Trees(np.zeros((0, 15), int), np.zeros((0, 15)), np.zeros((0, 16)), 0.0))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    quality.fit(make([(4, f"text {i}") for i in range(3000)] + [(i, "one") for i in range(8, 12)]), labels, 10)
    assert held[0][0] <= 10


def test_language_sample_is_bounded_by_rows(make, monkeypatch):
    held = []
    monkeypatch.setattr(language, "train", lambda sample: held.append(len(sample)))
    language.fit(make([(4, "the same row", "en")] * 5000 + [(i, f"t {i}", "de") for i in range(8, 400, 4)]), 50)
    assert held[0] < 150


def test_tags_are_removed_in_linear_time():
    began = time.time()
    assert len(url_filter.untagged("<" * 2_000_000)) == 2_000_000
    assert len(url_filter.untagged("a<b>" * 300_000 + "<" * 1_000_000)) == 600_000 + 1_000_000
    assert time.time() - began < 5
    rng = random.Random(2)
    for _ in range(2000):
        html = "".join(rng.choices("<<>ab ", k=rng.randint(0, 30)))
        assert url_filter.untagged(html) == re.sub(r"<[^>]*>", " ", html)


def test_scores_of_many_copies(make, monkeypatch):
    docs = make([(1, "a b a b c")] * 95 + [(2, "a c"), (2, "a c"), (3, None)])
    want = Counter(rows(lm_score.score(docs)))
    monkeypatch.setattr(lm_score, "COPIES", 10)
    got = Counter(rows(lm_score.score(docs)))
    assert got == want and sorted(got.values()) == [1, 2, 95]


def test_filters_by_range_of_hashes(make, monkeypatch):
    docs = make([(i, f"t{i % 700}") for i in range(900)] + [(5, "hot")] * 400 + [(None, None), (6, "")])
    groups, left = Counter(rows(exact_dedup.exact_groups(docs))), sorted(rows(exact_dedup.drop_copies(docs), "doc_id", "text"), key=str)
    monkeypatch.setattr(exact_dedup, "ROWS", 200)
    assert Counter(rows(exact_dedup.exact_groups(docs))) == groups
    assert sorted(rows(exact_dedup.drop_copies(docs), "doc_id", "text"), key=str) == left
    assert len(left) == 700 + 2 and {(5, "hot"), (6, "")} <= set(left)


def plain_packer(documents, window, most):
    """The rules word by word: windows are lists of (document, start, length)."""
    done, opened = [], []
    fill = lambda w: sum(p[2] for p in w)
    for doc, n in documents:
        start = 0
        while n - start >= window:
            done.append([(doc, start, window)])
            start += window
        if start == n:
            continue
        fits = [w for w in opened if fill(w) + n - start <= window]
        if not fits and len(opened) == most:
            fullest = max(opened, key=lambda w: (fill(w), opened.index(w)))
            room = window - fill(fullest)
            opened.remove(fullest)
            done.append([*fullest, (doc, start, room)])
            start += room
        if fits:
            best = max(fits, key=fill)
            best.append((doc, start, n - start))
        else:
            opened.append(best := [(doc, start, n - start)])
        if fill(best) == window:
            opened.remove(best)
            done.append(best)
    return done, sorted(map(fill, opened))


@pytest.mark.parametrize("seed", range(5))
def test_packer_equals_plain_rules(seed):
    rng = random.Random(seed)
    sizes = [(d, rng.choice([rng.randint(1, 10), rng.randint(1, 60), rng.randint(1, 200)])) for d in range(400)]
    done = []
    packer = packing.Packer(50, 4, lambda pieces: done.append([(d, start, len(ids)) for d, start, ids, _ in pieces]))
    for d, n in sizes:
        packer.add(d, np.arange(n, dtype=np.uint32))
    want, left = plain_packer(sizes, 50, 4)
    # Windows with equal fill may take each other's place; what is emitted and left has the same sizes.
    assert [sum(p[2] for p in w) for w in done] == [sum(p[2] for p in w) for w in want] == [50] * len(done)
    assert sorted(w[0] for w in packer.open) == left
    assert sum(n for _, n in sizes) == 50 * len(done) + sum(left)
    full = len(done)
    rest = packer.finish()
    assert sum(len(p[2]) for p in rest) == sum(left) % 50 and len(done) - full == sum(left) // 50


@pytest.mark.parametrize("seed", range(4))
def test_split_equals_search_over_all_cuts(seed):
    """One tree of depth one against the gain of every cut at a bin's edge of every feature, from plain sums."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(200, 5)), 1)
    y = ((x[:, seed] > 0.3) ^ (rng.random(200) < 0.15)).astype(float)
    tree = quality.grow(x, y, trees=1, depth=1, rate=1.0, ridge=1.0)
    p = y.mean()
    best = {}
    for f in range(5):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS)[1:-1])):
            side = [x[:, f] <= cut, x[:, f] > cut]
            if min(s.sum() for s in side) * p * (1 - p) >= 1:
                best[f, cut] = sum(((p - y)[s].sum()) ** 2 / (s.sum() * p * (1 - p) + 1.0) for s in side)
    f, cut = int(tree.feature[0, 0]), tree.cut[0, 0]
    assert best[f, cut] > max(best.values()) - 1e-9
    side = [x[:, f] <= cut, x[:, f] > cut]
    want = [-(p - y)[s].sum() / (s.sum() * p * (1 - p) + 1.0) for s in side]
    assert np.allclose(tree.leaf[0], want)
