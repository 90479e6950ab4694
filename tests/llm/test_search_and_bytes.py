"""Hard negatives, byte-level BPE and lexical search against plain versions, and odd input."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from weir.llm import byte_bpe, hard_negatives, lexical, queries
from weir.llm.common import materialise

from .conftest import ODD

MULTI = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken")


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


# 11 ------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("most", [3, 500, 40_000, 1 << 31, 1 << 62])
def test_products_are_exact(most):
    rng = random.Random(most)
    a, b = (np.array([[rng.randint(-most, most) for _ in range(130)] for _ in range(n)], np.int64) for n in (5, 7))
    a[0], b[0], b[1] = most, most, -most
    assert (hard_negatives.multiply(a, b).astype(object) == a.astype(object) @ b.astype(object).T).all()
    assert (hard_negatives.multiply(a * 0, b) == 0).all()


def test_residues_sum_below_float32():
    assert len(hard_negatives.PRIMES) == len(set(hard_negatives.PRIMES)) > 60
    assert hard_negatives.STEP * (max(hard_negatives.PRIMES) // 2) ** 2 < 1 << 24


def plain_negatives(data, positives, k, low=30, high=90):
    """data: (vec_id, label, ints)."""
    out = []
    anchors = {}
    for v, label, x in data:
        if v % 100 == 0:
            anchors[v] = min(anchors.get(v, (label, x)), (label, x))
    for a, (label, x) in anchors.items():
        scores = [(sum(p * q for p, q in zip(x, y, strict=True)), v, other) for v, other, y in data if v != a and len(y) == len(x)]
        best = sorted((s for s in scores if s[2] == label), key=lambda s: (-s[0], s[1]))[:positives]
        for place, (ps, p, _) in enumerate(best, 1):
            fit = sorted((s for s in scores if s[2] != label and low * ps <= 100 * s[0] <= high * ps), key=lambda s: (-s[0], s[1]))[:k]
            out += [(a, p, rank, v, ps, s, place) for rank, (s, v, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, data, positives, k):
    df = spark.createDataFrame([(v, [float(c) for c in x], label, 0) for v, label, x in data], "vec_id long, embedding array<double>, label int, row long")
    used = materialise(hard_negatives.usable(df, 1, F.col("label")))
    return sorted(rows(hard_negatives.mine(used, used.filter("vec_id % 100 = 0"), positives, k)))


def test_mined_against_all_products(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LANE", 40)
    monkeypatch.setattr(hard_negatives, "SET", 3)
    rng = random.Random(3)
    data = [(v, rng.choice([0, 0, 0, 1, 2]), [rng.randint(-2, 4) for _ in range(rng.choice([3, 3, 3, 2]))]) for v in range(0, 1400, 4) if v != 100]
    data += [(5, 1, [1, 1, 1])] * 60 + [(100, 0, [1, 2, 3])] * 2 + [(100, 1, [0, 0, 1])]  # one vector many times, an anchor twice
    assert mined(spark, data, 3, 4) == plain_negatives(data, 3, 4)


def test_mined_huge_components(spark):
    data = [(0, 0, [float(1 << 40), 1.0]), (1, 0, [float(1 << 40), 2.0]), (2, 1, [float(1 << 39), 3.0]), (3, 1, [-1.0, 0.0]), (4, 1, [float(1 << 13), 0.0])]
    most = (1 << 63) - 1
    got = mined(spark, data, 5, 10)
    assert got == []  # both scores are taken as the largest 64-bit number, none is below 90 % of the other but those far below 30 %
    near = [(0, 0, [float(1 << 31), 0.0]), (1, 0, [float(1 << 31), 0.0]), (2, 1, [float(1 << 30), 3.0])]
    assert mined(spark, near, 5, 10) == [(0, 1, 1, 2, 1 << 62, 1 << 61, 1)] and most > 1 << 62


def test_mined_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0], 1), (100, None, 1), (200, [1.0, nan], 1), (300, [1.0, 1.0], None), (None, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [inf, 0.0], 2), (4, [None, 1.0], 2), (5, [], 2), (6, [1.0], 2), (7, [1.0, 5.0], 2)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("lane", F.lit("x"))
    used = materialise(hard_negatives.usable(df, 10, F.col("label")))
    assert sorted(rows(used.select("vec_id"))) == [(0,), (1,), (2,), (6,), (7,)]
    assert sorted(rows(hard_negatives.mine(used, used.filter("vec_id % 100 = 0")))) == [(0, 1, 1, 2, 200, 100, 1), (0, 1, 2, 7, 200, 100, 1)]
    none = used.limit(0)
    assert rows(hard_negatives.mine(none, none)) == []


# 12 ------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteBpe(MULTI, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


LETTERS = "aabcdeeinorst  'sSTI019-,.éÜßñ<|>ΣİǺ 中文日本語😀ٱаби\n\t\x85՘౜ 𑷠"


def test_bytes_equal_library(coder, library):
    rng = random.Random(7)
    every = [chr(x) for x in [*range(0x20, 0x3000), *range(0x4E00, 0x4F00), *range(0xA7C0, 0xA800), *range(0x11DE0, 0x11DF0)]]
    for i in range(3000):
        x = "".join(rng.choices(LETTERS if i % 2 else every, k=rng.randint(0, 70)))
        ids, decoded = coder.encode(x)
        assert np.frombuffer(ids, np.int32).tolist() == library.encode_ordinary(x) and decoded == x.encode()


def test_every_token_is_its_own_encoding(coder, library):
    for token, rank in list(coder.ranks.items())[::37]:
        assert coder.follow(token, coder.fresh(token)) == [rank]
        if rank in coder.halves:
            assert b"".join(coder.bytes[i] for i in coder.halves[rank]) == token


@pytest.mark.parametrize("text", ["a" * 300_000, "ab1!" * 50_000, "é" * 100_000, "\n" * 50_000])
def test_long_runs(coder, library, text):
    assert np.frombuffer(coder.encode(text)[0], np.int32).tolist() == library.encode_ordinary(text)


def test_edits_equal_encoding_anew(coder, library):
    rng = random.Random(11)
    for i in range(400):
        letters = LETTERS if i % 3 else "abcde"
        text = byte_bpe.Encoded(coder, "".join(rng.choices(letters, k=rng.randint(0, 200))))
        for _ in range(4):
            a = rng.randint(0, len(text.text))
            b, new = min(len(text.text), a + rng.randint(0, 5)), "".join(rng.choices(letters, k=rng.randint(0, 6)))
            text.append(new) if rng.random() < 0.3 else text.edit(a, b, new)
            assert text.ids == library.encode_ordinary(text.text)


def test_edits_are_local(coder):
    """A long match is not computed again beyond some lengths of the longest token, nor are other matches."""
    rng = random.Random(13)
    text = byte_bpe.Encoded(coder, "".join(rng.choices("abcdefgh", k=20_000)))
    before = text.computed
    text.edit(10_000, 10_001, "z")
    text.append("abc")
    assert text.computed - before < 20 * coder.longest
    text = byte_bpe.Encoded(coder, "some words here " * 1000)
    before = text.computed
    text.edit(8000, 8001, "x")
    assert text.computed - before < 50


def test_byte_frame(odd, empty, library):
    got = byte_bpe.encode_texts(odd, MULTI, public_tokenizers.PATTERN)
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in ODD]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in got.collect()), key=key) == sorted(want, key=key)
    assert all(r.n_tokens == len(r.ids) for r in got.collect())
    assert rows(byte_bpe.encode_texts(empty, MULTI, public_tokenizers.PATTERN)) == []


def test_stored_and_edited_columns(spark, library):
    data = [("the cat sat on the mat", 4, 7, "dog"), ("été 中文", 100, 200, " more"), ("x", 0, 1, None), (None, 0, 0, "new"), ("abc", None, None, "z"), ("", 5, 2, "")]
    df = spark.createDataFrame(data, "text string, a int, b int, new string")
    state = byte_bpe.stored(F.col("text"), MULTI, public_tokenizers.PATTERN)
    done = materialise(df.select("*", state.alias("s")))
    got = done.select("text", "a", "b", "new", "s.ids", byte_bpe.edited(F.col("s"), F.col("a"), F.col("b"), F.col("new"), MULTI, public_tokenizers.PATTERN).alias("e")).collect()
    for r in got:
        text, a, b = r.text or "", min(r.a or 0, len(r.text or "")), r.b or 0
        after = text[:a] + (r.new or "") + text[max(a, b) :]
        assert list(r.ids) == library.encode_ordinary(text)
        assert r.e.text == after and list(r.e.ids) == library.encode_ordinary(after)
    assert got[0].e.computed < len(data[0][0])


# 13 ------------------------------------------------------------------------------------------------
def plain_search(docs, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    own = [(d, Counter(words(t))) for d, t in docs]
    own = [(d, tf, sum(tf.values())) for d, tf in own if tf]
    n, length = len(own), sum(x[2] for x in own)
    df = Counter(t for _, tf, _ in own for t in tf)
    out = []
    for item, text in set(items):
        found = []
        for d, tf, size in own:
            m = 50 + 50 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(words(text)) if t in tf)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return out


def ordered(found):
    return sorted(found, key=lambda r: tuple((x is None, x or 0) for x in (*r[:2], r[3], r[2])))


def test_search_against_all_scores(spark, make, monkeypatch):
    monkeypatch.setattr(lexical, "PAIRS", 60)  # several blocks of items
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "ÉTÉ", "été", "Straße", "中文", "naïve", "a'b"]
    text = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.02)), len(vocabulary) - 1)] if rng.random() < 0.9 else rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.choice([1, 3, 20, 60, 400]))) for i in range(400)]
    docs += [(1000 + i, "w250 w251 W252") for i in range(40)] + [(7, "w250 w251 w252")] * 3 + [(None, "w250 w251"), (None, None), (None, "été w1")]
    docs += [(2000, text(30_000)), (2001, "w3 " * 5000), (2002, None), (2003, ""), (2004, ".,;")]
    items = [(i, text(rng.choice([1, 5, 30]))) for i in range(30)] + [(3, "w1 w2"), (3, "w1 w2"), (50, None), (51, "..."), (52, "W250, w251!"), (53, "absent"), (None, "w5 w299")]
    queries_ = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, place int")
    assert ordered(rows(lexical.search(make(docs), queries_, 10))) == ordered(plain_search(docs, items, 10))


def test_search_empty_and_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, "a b x"), (2, None)], "item_id long, text string")
    assert ordered(rows(lexical.search(odd, items, 3))) == ordered(plain_search(ODD, [(1, "a b x"), (2, None)], 3))
    assert rows(lexical.search(empty, items)) == [] and rows(lexical.search(odd, items.limit(0))) == []
    assert rows(lexical.search(odd.filter("doc_id in (1, 2, 3, 10)"), items)) == []


def test_bounds_hold_and_exclude(make):
    """Every bound reaches the exact score; most documents are excluded by them."""
    rng = random.Random(9)
    docs = [(i, " ".join(f"t{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(1, 300)))) for i in range(1500)]
    blocks = [r.asDict() for r in lexical.index(make(docs)).filter("kind = 'block'").collect()]
    assert sorted(i for b in blocks for i in b["doc_ids"]) == [i for i, _ in docs]
    df = Counter(t for _, x in docs for t in set(lexical.terms(x)))
    weight = {t: math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * n + 1))) for t, n in df.items()}
    own = [lexical.terms(" ".join(f"t{int(rng.paretovariate(0.7))}" for _ in range(20))) for _ in range(12)]
    items = lexical.Items(list(range(12)), own, weight, len(docs), sum(len(lexical.terms(x)) for _, x in docs))
    text, above, close = dict(docs), 0, 0
    for b in blocks:
        for i, upper in items.bounds(b):
            for j in range(upper.shape[1]):
                exact = items.score(text[b["doc_ids"][i + j]], range(12))
                assert all(u >= s for u, s in zip(upper[:, j], exact, strict=True))
                above += sum(upper[:, j] > 0)
                close += sum(s > 0 and u < 1.6 * s for u, s in zip(upper[:, j], exact, strict=True))
    assert close > 0.8 * above


def test_filled_signatures_stay_bounds(make, monkeypatch):
    """Documents with more terms than the widest signature tells apart are found all the same."""
    docs = [(i, " ".join(f"t{i * 7 + j}" for j in range(400))) for i in range(20)]
    keys = [lexical.level_keys(lexical.hashes(lexical.terms(t)), 0) for _, t in docs]
    kept = lexical.slices(256, keys)
    for row, own in enumerate(keys):
        assert all(np.unpackbits(kept[b], axis=1)[:, row].all() for b in lexical.bits(own, 256))
