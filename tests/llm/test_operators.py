"""Each operator against a plain version, held-out accuracy, and odd input."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weir.llm import bpe, components, exact_dedup, jaccard_join, language, lm_score, mtree, packing, quality, queries, sharding, url_filter
from weir.llm.common import join_groups, table

from .conftest import ODD

WORD = queries.tokenizer_file("word_bpe_49k.json")
BYTE = queries.tokenizer_file("byte_bpe_50k.json")


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


# 1 -------------------------------------------------------------------------------------------------
def test_mtree_against_all_products(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.2, (3000, 8))
    x[100:400] = x[100]  # many ties
    x[7] = 0
    tree = mtree.MTree(pd.DataFrame(mtree.build(np.arange(3000), np.floor(x * 1024))), 8)
    v = np.floor(x * 1024)
    for q in range(0, 3000, 150):
        got, score = tree.search(q, v[q], 10)
        s = v @ v[q]
        want = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:10]
        assert got.tolist() == want and score.tolist() == s[want].tolist()


def test_mtree_skips_far_pages():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(50, 16))
    x = np.floor(1000 * centres[np.arange(4000) % 50] / np.linalg.norm(centres, axis=1)[np.arange(4000) % 50, None] + rng.normal(size=(4000, 16)))
    pages = mtree.build(np.arange(4000), x)
    tree = mtree.MTree(pd.DataFrame(pages), 16)
    seen = []
    tree.pages = type("Seen", (dict,), {"__getitem__": lambda self, k: (seen.append(k), dict.__getitem__(self, k))[1]})(tree.pages)
    tree.search(-1, x[3], 5)
    assert len(seen) < len(pages) / 3


def test_top_k_odd_vectors(spark):
    data = [(0, [1.0, 0.0]), (100, [0.5, 0.5]), (1, [1.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [1.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    u = mtree.usable(df)
    got = sorted(rows(mtree.top_k(u, u.filter("vec_id % 100 = 0"), 3), "query_id", "rank", "vec_id", "score"))
    m = 1024 * 1024
    assert got == [(0, 1, 1, m), (0, 2, 8, m), (0, 3, 8, m), (100, 1, 1, m), (100, 2, 8, m), (100, 3, 8, m)]
    none = u.limit(0)
    assert rows(mtree.top_k(none, none)) == []


# 2 -------------------------------------------------------------------------------------------------
def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_library(spark, sf):
    t, coder = library(WORD), bpe.Bpe(WORD)
    rng = random.Random(5)
    letters = "aabcdeeinorst  'sSTI019-,.éÜßñ<|>ΣİǺ 中文😀ٱ\n\t\x85"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 70))) for _ in range(3000)] + ["ab" * 400, "don't WE'LL", *[x or "" for _, x in ODD]]
    texts += [r.text for r in table(spark, sf, "documents").limit(300).collect()]
    for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        ids, decoded, n = coder.encode(x)
        assert ids == " ".join(map(str, e.ids)) and n == len(e.ids)
        assert decoded == t.decode(e.ids, skip_special_tokens=False) == coder.decode(e.ids)


def test_bpe_frame(odd, empty):
    got = rows(bpe.encode_texts(odd, WORD))
    assert len(got) == len(ODD) and {r[1] for r in got if r[0] in (1, 2, 3, 10)} == {0}
    assert rows(bpe.encode_texts(empty, WORD)) == []


# 3 -------------------------------------------------------------------------------------------------
def check_shards(docs, got, shards, overhead):
    assert Counter((d, s, c) for d, s, c, _, _ in got) == Counter((d, len((t or "").encode()) + overhead, zlib.crc32((t or "").encode())) for d, t in docs)
    by = defaultdict(list)
    for d, s, _, shard, slot in got:
        by[shard].append((slot, d, s))
    assert all(sorted(x[0] for x in v) == list(range(len(v))) for v in by.values())
    total, most = sum(r[1] for r in got), max((r[1] for r in got), default=0)
    assert all(abs(sum(x[2] for x in by[k]) - total / shards) <= most for k in range(shards))
    ids = [(-1 if d is None else d) for k in sorted(by) for _, d, _ in sorted(by[k], key=lambda x: x[0])]
    assert ids == sorted(ids)  # contiguous


def test_shards(spark, sf, odd, empty):
    docs = table(spark, sf, "documents")
    for df, shards in ((docs, 24), (odd, 3)):
        got = rows(sharding.shards_by_bytes(df, shards, 8), "doc_id", "size", "text_crc32", "shard", "slot")
        check_shards(rows(df, "doc_id", "text"), got, shards, 8)
    assert rows(sharding.shards_by_bytes(empty)) == []


# 4 -------------------------------------------------------------------------------------------------
def test_language(spark, sf, odd, empty):
    got = queries.op4_language(spark, sf).join(table(spark, sf, "documents"), "doc_id").select("held_out", "lang_pred", "lang", "rejected").collect()
    apart = [r for r in got if r.held_out]
    assert len(apart) > 200 and sum(r.lang_pred == r.lang for r in apart) / len(apart) > 0.98
    assert sum(r.rejected for r in got) < 0.02 * len(got)
    model = language.fit(odd)
    assert {r.p.lang_pred for r in odd.select(language.predict(odd.text, model).alias("p")).collect()} == {"und"}
    assert empty.select(language.predict(empty.text, model).alias("p")).collect() == []
    model = language.fit(table(spark, sf, "documents"))
    assert model.predict("12 34 !")[:2] == ("und", 0.0) and model.predict(None)[2]


def test_language_rare_and_few(spark, make):
    """Every language is learnt, however rare; with less than five documents of each nothing is kept apart."""
    docs = [(i, "the quick brown fox jumps", "en") for i in range(0, 3000)] + [(5000 + i, "zażółć gęślą jaźń", "pl") for i in range(3)]
    model = language.fit(make(docs), 40)
    assert model.languages == ["en", "pl"] and model.predict("gęślą jaźń")[0] == "pl"
    few = language.fit(make([(4, "eins zwei drei", "de"), (4, "one two three", "en")]))
    assert few.threshold == 0.0 and few.predict("zwei")[:1] == ("de",) and not few.predict("zwei")[2]
    with pytest.raises(ValueError):
        language.fit(make([(4, f"word {k}", f"l{k}") for k in range(6)]), 5)


def test_language_softmax_against_plain_steps(monkeypatch):
    """One epoch of training, example by example, with plain loops."""
    monkeypatch.setattr(language, "BUCKETS", 8)
    rng = np.random.default_rng(5)
    sample = [("ab"[k % 2], np.array([k % 8, (k * 3 + 1) % 8]) if k % 8 != (k * 3 + 1) % 8 else np.array([k % 8]), None) for k in range(8)]
    sample = [(lang, np.sort(at), rng.integers(1, 5, len(at)).astype(np.float32)) for lang, at, _ in sample]
    got = language.train(sample, dim=3, epochs=1, rate=0.5)
    r = np.random.default_rng(7)
    r.permutation(8), r.permutation(8)
    e, w, scale = r.normal(0, 0.3, (8, 3)), r.normal(0, 0.3, (3, 2)), np.sqrt(8) / 8
    de, dw = np.zeros_like(e), np.zeros_like(w)
    for lang, at, n in sample:
        share = n / n.sum()
        mean = sum(share[i] * e[b] for i, b in enumerate(at)) * scale
        z = [sum(mean[d] * w[d, c] for d in range(3)) for c in range(2)]
        p = [np.exp(x) / sum(np.exp(y) for y in z) for x in z]
        for c in range(2):
            g = (p[c] - (c == "ab".index(lang))) / len(sample)
            dw[:, c] += g * mean
            for i, b in enumerate(at):
                de[b] += g * w[:, c] * share[i] * scale
    table = (e - 0.5 * de) @ (w - 0.5 * dw) * scale
    assert np.abs(got.table - table).max() < 1e-4 and got.threshold == 0.0


def test_language_counts_in_pieces(monkeypatch):
    text = "The quick brown fox. " * 30
    whole = language.counts(text)
    monkeypatch.setattr(language, "PIECE", 17)
    assert (language.counts(text) == whole).all() and whole.sum() == 3 * (len(text) + 2) - 6


# 5 -------------------------------------------------------------------------------------------------
def test_url_parts_and_rules(spark):
    urls = [None, "no scheme", "http://A.Example.NET/en/x?y#z", "https://sub.example.com/de/1", "http://x.org/fr/", "http://org/fr/a", "http://y.net", "http://y.net/", "http://z.com?q=http://w.net/", "://b.net/q", "http://notexample.net/en/", "http://q.org/FR/"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[3] == ("sub.example.com", "/de/1", "example.com/de/", "block")
    assert got[4][2:] == got[5][2:] == ("org/fr/", "allow")
    assert got[6][:3] == ("y.net", "", None) and got[7][2:] == ("net/", "block")
    assert got[8][:3] == ("z.com", "", None) and got[9][2] == "net/" and got[10][2] == "net/" and got[11][2] is None
    assert url_filter.judge(df.limit(0)).collect() == []


def plain_split(words, total, s):
    """The cheapest of all splits."""
    cost = lambda w: -np.log(words[w] / total) if w in words else np.log(total) + 2.3 * len(w)
    cuts = ([0, *c, len(s)] for n in range(len(s)) for c in itertools.combinations(range(1, len(s)), n))
    return min(sum(cost(s[i:j]) for i, j in itertools.pairwise(c)) for c in cuts)


def test_url_split_is_the_cheapest():
    words = {"casino": 10, "win": 20, "bets": 5, "free": 30, "the": 50, "thing": 9, "in": 40}
    s = url_filter.Segmenter(words)
    assert s.split("freecasinowin") == ("free", "casino", "win") and s.split("thething") == ("the", "thing")
    assert s.split("") == () and s.split("q" * 500) == ("q" * 500,) and url_filter.Segmenter({}).split("any") == ("any",)
    rng = random.Random(3)
    for _ in range(60):
        x = "".join(rng.choice(["the", "in", "q", "win", "xz", "thing"]) for _ in range(3))[:11]
        cost = sum(s.cost.get(w, np.log(s.total) + 2.3 * len(w)) for w in s.split(x))
        assert "".join(s.split(x)) == x and abs(cost - plain_split(words, s.total, x)) < 1e-9


def plain_odds(urls, rules, split):
    """Log odds of blocked of each address: naive Bayes over the addresses that a rule decides."""
    label, words = {}, {}
    for u in urls:
        m = url_filter.re.match(r"[^:]*://([^/?#]*)([^?#]*)", u)
        h, p = m[1].lower(), m[2]
        fits = [(len(rh + rp), act) for act, rh, rp in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        at = h + url_filter.re.sub("[0-9]+", "0", p)
        label[at] = max(fits)[1] if fits else None
        words[at] = [w for run in url_filter.runs(h) for w in (["0"] if run[0].isdigit() else split(run))] + url_filter.path_words(url_filter.re.sub("[0-9]+", "0", p))
    n = {act: Counter(w for at in label if label[at] == act for w in words[at]) for act in ("block", "allow")}
    known, size = set(n["block"]) | set(n["allow"]), Counter(label.values())
    lean = lambda w: np.log((n["block"][w] + 1) / (sum(n["block"].values()) + len(known))) - np.log((n["allow"][w] + 1) / (sum(n["allow"].values()) + len(known)))
    return {at: np.log(size["block"] / size["allow"]) + sum(lean(w) for w in words[at] if w in known) for at in label}


def test_url_scores_against_plain_bayes(spark):
    hosts = ["freecasino.org", "casinowin.com", "thething.org", "newsthing.com", "été-win.org", "winfree.net"]
    urls = [f"https://{h}/{p}/{k}?q" for k, (h, p) in enumerate(itertools.product(hosts, ("en/news", "de/Casino", "x_1")))] * 2
    html = ["<b class=x>casino free win news the thing casino free win news the thing</b>"]
    df = spark.createDataFrame([(i, u, html[i] if i < 1 else None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    rules = (("block", "casinowin.com", "/"), ("allow", "newsthing.com", "/"), ("allow", "thething.org", "/en/"))
    s = url_filter.Segmenter({"casino": 2, "free": 2, "win": 2, "news": 2, "the": 2, "thing": 2})
    want = plain_odds(urls, rules, s.split)
    got = {r.host + url_filter.re.sub("[0-9]+", "0", r.path): (r.log_odds, r.verdict, r.rule) for r in url_filter.judge(df, rules).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k]) < 1e-9 for k in want)
    free = {k: v for k, (_, v, r) in got.items() if r is None}
    assert all((v == "block") == (want[k] > 0) for k, v in free.items()) and set(free.values()) == {"block", "allow"}
    assert {r.verdict for r in url_filter.judge(df, rules[:1]).filter("rule is null").collect()} == {"allow"}  # nothing to learn


def test_url_pages(spark, sf):
    got = url_filter.judge(table(spark, sf, "pages")).collect()
    assert len(got) == table(spark, sf, "pages").count()
    free = [r for r in got if r.rule is None]
    assert {r.verdict for r in free} == {"block", "allow"} and all((r.verdict == "block") == (r.log_odds > 0) for r in free)


def test_url_rare_and_long_words_count(spark):
    """Words far rarer than 1/65536 of all still split hosts and have a weight; long words stay whole."""
    page = lambda k: f"http://plain.org/{'/'.join(f'w{chr(97 + k % 26)}{chr(97 + j % 26)}' for j in range(52))}/x{chr(97 + k % 26)}"
    long_ = "rindfleischetikettierungsgesetz"
    urls = [page(k) + "/" + "".join(chr(97 + int(d)) for d in str(k)) for k in range(3000)] + ["http://pharmacheap.net/", "http://cheappharma.com/", f"http://{long_}cheap.com/", "http://" + "x" * 3000 + ".com/" + "y/" * 30_000]
    html = ["filler " * 200_000 + f"cheap pharma cheap pharma {long_} {long_}"]
    df = spark.createDataFrame([(i, u, html[i] if i < len(html) else None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.host: r for r in url_filter.judge(df, (("block", "net", "/"), ("allow", "plain.org", "/"))).filter("host <> 'plain.org'").collect()}
    assert got["cheappharma.com"].host_words == ["cheap", "pharma"] and got[f"{long_}cheap.com"].host_words == [long_, "cheap"]
    assert got["cheappharma.com"].verdict == "block" and got["x" * 3000 + ".com"].host_words == ["x" * 3000]


# 6 -------------------------------------------------------------------------------------------------
def brute_groups(docs, n, percent):
    sets = {}
    for i, (_, t) in enumerate(docs):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        o = len(sets[a] & sets[b])
        if o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
            root[find(a)] = find(b)
    low = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        low[find(i)] += [] if d is None else [d]
    return sorted(((d, len(sets[i]), min(low[find(i)], default=None)) for i, (d, _) in enumerate(docs)), key=str)


def near_copies(seed, size, length, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(length)] = f"e{rng.randrange(10**6)}" if rng.random() < 0.7 else "e"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("n", "percent", "edits"), [(3, 90, 6), (5, 80, 7), (3, 90, 14)])
def test_groups_against_all_pairs(make, monkeypatch, n, percent, edits):
    monkeypatch.setattr(jaccard_join, "TOGETHER", 2)  # counters are summed in two steps
    texts = near_copies(1, 60, 120, edits) + near_copies(2, 40, 60, edits) + near_copies(3, 15, 12, 1) + ["same text here now"] * 5 + [f"short {i}" for i in range(5)]
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [f"{' '.join(f'u{k}x{i}' for i in range(k % 30))} {passage}" for k in range(40)]
    docs = [(1000 - i, t) for i, t in enumerate(texts)] + [(d, t) for d, t in ODD]
    got = sorted(rows(jaccard_join.groups(make(docs), n, percent), "doc_id", "n_shingles", "component_id"), key=str)
    assert got == brute_groups(docs, n, percent)


def test_groups_empty_and_keep_one(make, empty, sf, spark):
    assert rows(jaccard_join.groups(empty)) == []
    assert rows(jaccard_join.keep_one(empty)) == []
    docs = list(enumerate(near_copies(5, 30, 200, 2) + ["other text with several words in it", None, ""]))
    kept = jaccard_join.keep_one(make(docs), 5, 80)
    assert kept.columns == make(docs).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, c in brute_groups(docs, 5, 80) if d == c)


def test_keep_one_equal_and_null_ids(make):
    """One row of each group stays, and no row goes because another with its id does."""
    a, b, c, d = (near_copies(seed, 3, 200, 1) for seed in (11, 12, 13, 14))
    alone = [f"{k} has nothing in common with any other text at all" for k in ("first", "second", "third")]
    docs = [(3, a[0]), (7, a[1]), (None, a[2]), (7, alone[0]), (None, alone[1]), *((None, x) for x in b), *((5, x) for x in c), (5, c[0]), (9, d[0]), (9, d[0]), (9, alone[2]), (None, None), (7, "")]
    kept = [tuple(r) for r in rows(jaccard_join.keep_one(make(docs), 5, 80), "doc_id", "text")]
    singles = [(3, a[0]), (7, alone[0]), (None, alone[1]), (9, d[0]), (9, alone[2]), (None, None), (7, "")]
    assert [kept.count(x) for x in singles] == [1] * len(singles)
    others = [x for x in kept if x not in singles]
    assert len(others) == 2 and {i for i, _ in others} == {None, 5} and all(x in (b if i is None else c) for i, x in others)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (300, 100)] + [(1000, k) for k in range(1001, 1300)] + [(7, 7)]
    got = dict(rows(components.components(spark.createDataFrame(chain, "a long, b long"))))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 200, 300)} == {100} and {got[k] for k in range(1000, 1300)} == {1000}


# 7 -------------------------------------------------------------------------------------------------
def test_lm_against_plain_counts(make, empty):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices("a b c D e f g hh i j".split(), k=rng.randrange(0, 30)))) for i in range(200)] + ODD
    got = Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows(lm_score.score(make(docs)), "doc_id", "n_words", "n_backoff", "log_score"))
    split = [(d, (t or "").encode().lower().split()) for d, t in docs]
    uni, big, ctx = Counter(), Counter(), Counter()
    for _, w in split:
        uni.update(w)
        big.update(zip([None, *w[:-1]], w, strict=False))
        ctx.update([None, *w[:-1]] if w else [])
    total, want = sum(uni.values()), Counter()
    for d, w in split:
        s, back = 0.0, 0
        for v, x in zip([None, *w[:-1]], w, strict=False):
            hit = big[v, x] >= 2
            s += np.log(big[v, x] / ctx[v]) if hit else np.log(0.4 * uni[x] / total)
            back += not hit
        want[d, len(w), back, round(float(s), 6)] += 1
    assert got == want
    assert rows(lm_score.score(empty)) == []


def test_lm_rare_words(make, monkeypatch):
    """With few frequent words most counts come from the second round."""
    docs = [(i, f"common common w{i % 7} w{i % 11} only{i}") for i in range(120)]
    own = lambda: sorted((r[0], r[1], r[2], round(r[3], 6)) for r in rows(lm_score.score(make(docs))))
    want = own()
    monkeypatch.setattr(lm_score, "FREQUENT", 4)
    assert own() == want


@pytest.mark.parametrize("often", [2, 64, 1 << 16])
def test_lm_pair_in_every_document(make, monkeypatch, often):
    """A bigram of every document is scored where the documents are; the others come from their partitions."""
    docs = [(i, f"hot pair hot pair w{i % 7} w{i % 11} only{i}") for i in range(150)] + ODD
    monkeypatch.setattr(lm_score, "OFTEN", often)
    monkeypatch.setattr(lm_score, "CHUNK", 100)
    own = sorted((str(r[0]), r[1], r[2], round(r[3], 6)) for r in rows(lm_score.score(make(docs))))
    monkeypatch.setattr(lm_score, "often", lambda *_: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    assert own == sorted((str(r[0]), r[1], r[2], round(r[3], 6)) for r in rows(lm_score.score(make(docs))))


# 8 -------------------------------------------------------------------------------------------------
def check_packed(docs, got, window):
    ids = {d: [*e, 1] for d, e in docs.items()}
    seqs, pieces = defaultdict(list), defaultdict(list)
    for d, start, length, blob, n, seq, offset in got:
        own = np.frombuffer(blob, "<u4").tolist()
        assert len(own) == length > 0 and n == len(ids[d]) and own == ids[d][start : start + length]
        seqs[seq].append((offset, length))
        pieces[d].append((start, length))
    for v in (*seqs.values(), *pieces.values()):
        at = 0
        for start, length in sorted(v):
            assert start == at
            at += length
    assert all(sum(x[1] for x in pieces[d]) == len(e) for d, e in ids.items())
    sizes = [sum(x[1] for x in v) for v in seqs.values()]
    assert max(sizes, default=0) <= window
    return sum(window - s for s in sizes if s & (s - 1)), sum(sizes)


def test_packing(spark, sf, odd, empty):
    t = library(BYTE)
    docs = table(spark, sf, "documents").filter("doc_id < 300")
    got = rows(packing.pack(docs, lambda: packing.byte_bpe(BYTE)))
    pad, total = check_packed({d: t.encode(x or "", add_special_tokens=False).ids for d, x in rows(docs, "doc_id", "text")}, got, 2048)
    assert pad == 0 and total > 100_000
    single = odd.dropDuplicates(["doc_id"])
    check_packed({d: t.encode(x or "", add_special_tokens=False).ids for d, x in rows(single, "doc_id", "text")}, rows(packing.pack(single, lambda: packing.byte_bpe(BYTE), 64, open_windows=2)), 64)
    assert rows(packing.pack(empty, lambda: packing.byte_bpe(BYTE))) == []
    assert len({r[0] for r in rows(packing.pack(odd, lambda: packing.byte_bpe(BYTE)))}) == len({d for d, _ in ODD})


def test_byte_ids_equal_library():
    t, enc, rng = library(BYTE), packing.byte_bpe(BYTE), random.Random(2)
    texts = ["".join(rng.choices("aab e'sT09 .é中😀\n\t<|>", k=rng.randint(0, 60))) for _ in range(2000)] + [x or "" for _, x in ODD]
    assert [x.tolist() for x in enc(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_long_white_space_equals_library(make):
    t = library(BYTE)
    docs = {1: "a" + " " * 2_000_000 + "b", 2: "\n" * 300_000, 3: " \u2003" * 150_000 + "x"}
    check_packed({d: t.encode(x, add_special_tokens=False).ids for d, x in docs.items()}, rows(packing.pack(make(list(docs.items())), lambda: packing.byte_bpe(BYTE))), 2048)


def test_short_windows_of_all_partitions_merge(make):
    t = library(BYTE)
    docs = {k: f"document {k} " * (k % 5) for k in range(200)}
    got = rows(packing.pack(make(list(docs.items())).repartition(16), lambda: packing.byte_bpe(BYTE), 64, open_windows=3))
    pad, total = check_packed({d: t.encode(x, add_special_tokens=False).ids for d, x in docs.items()}, got, 64)
    sizes = Counter()
    for r in got:
        sizes[r[5]] += r[2]
    assert pad == 0 and sum(s < 64 for s in sizes.values()) == bin(total % 64).count("1")


# 9 -------------------------------------------------------------------------------------------------
def test_quality(spark, sf, odd, empty, make):
    got = queries.op9_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    assert len(got) > 60
    good, bad = [r.score for r in got if r.quality], [r.score for r in got if not r.quality]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95 and sum(r.predicted == r.quality for r in got) / len(got) > 0.9
    labels = spark.createDataFrame([(4, None), (None, 1)], "doc_id long, quality int")
    trees = quality.fit(odd, labels)
    assert {r.s for r in odd.select(quality.score(odd.text, trees).alias("s")).collect()} == {0.5}
    assert empty.select(quality.score(empty.text, trees).alias("s")).collect() == []


def test_trees_flat_walk_equals_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = quality.grow(x, y, trees=20, depth=3)
    assert ((trees.score(x) > 0.5) == (y > 0)).mean() > 0.97
    for row, s in zip(x[:50], trees.score(x[:50]), strict=True):
        margin = trees.start
        for t in range(20):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(row[trees.feature[t, node]] > trees.cut[t, node])
            margin += trees.leaf[t, node - 7]
        assert abs(1 / (1 + np.exp(-margin)) - s) < 1e-9


# 10 ------------------------------------------------------------------------------------------------
def test_exact_groups(make, odd, empty):
    got = rows(exact_dedup.exact_groups(odd))
    by = defaultdict(list)
    for d, t in ODD:
        by[hashlib.sha256((t or "").encode()).hexdigest()].append(d)
    top = {h: max((d for d in v if d is not None), default=None) for h, v in by.items()}
    assert sorted((str(r[0]), r[4], r[1], r[2]) for r in got) == sorted((str(d), h, top[h], len(v)) for h, v in by.items() for d in v)
    kept = Counter(r[4] for r in got if r[3])
    assert set(kept) == set(by) and set(kept.values()) == {1} and all(r[0] == r[1] for r in got if r[3])
    assert rows(exact_dedup.exact_groups(empty)) == []
    left = exact_dedup.drop_copies(odd)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(top[h]) for h in by)
    hot = make([(i, "copy") for i in range(3000)] + [(i, f"t{i % 500}") for i in range(3000, 4000)])
    assert len(exact_dedup.drop_copies(hot).collect()) == 501
    assert Counter(r[2] for r in rows(exact_dedup.exact_groups(hot))) == {3000: 3000, 2: 1000}


def test_filter_lets_single_rows_pass(spark):
    n = 20_000
    df = spark.range(n).selectExpr("xxhash64(id) as h").unionAll(spark.range(500).selectExpr("xxhash64(id) as h"))
    bits, counters = exact_dedup.repeated_filter(df, n)
    shared = spark.sparkContext.broadcast(bits)
    got = spark.range(n).selectExpr("id", "xxhash64(id) as h").select("id", exact_dedup.maybe_repeated(F.col("h"), shared, counters).alias("m")).filter("m").collect()
    assert {r.id for r in got} >= set(range(500)) and len(got) < 500 + 0.02 * n


def test_join_groups(spark):
    left = spark.range(5000).selectExpr("id", "case when id < 3000 then 0 else id end as k")
    groups = left.groupBy("k").agg({"id": "count"}).withColumnRenamed("count(id)", "size")
    got = join_groups(left, groups, "k", "size", 5000)
    assert got.count() == 5000 and got.filter("size = 3000").count() == 3000


# pipeline ------------------------------------------------------------------------------------------
def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    docs = table(spark, sf, "documents").cache()
    before = {r.doc_id: r.text for r in docs.collect()}
    cols = docs.columns
    kept = {}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == cols
        docs = out.cache()
        kept[name] = {r.doc_id for r in docs.collect()}
        assert len(kept[name]) == docs.count()
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    clean = [d for d, q in labels.items() if q]
    assert sum(d in kept["language_id"] for d in clean) >= 0.99 * len(clean)
    assert sum(d in kept["quality"] for d in clean) >= 0.95 * len(clean)
    groups = defaultdict(list)
    for d in kept["quality"]:
        groups[before[d]].append(d)
    assert kept["exact_dedup"] == {max(v) for v in groups.values()}
    own = [(d, before[d]) for d in sorted(kept["exact_dedup"])]
    assert kept["near_dedup"] == {d for d, _, c in brute_groups(own, 5, 80) if d == c}
    pieces = p.STAGES[-1][1](spark, docs, sf).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id for r in pieces} == kept["near_dedup"] and all(r["sum(length)"] == r["max(doc_tokens)"] for r in pieces)


CLASHES = ["_language", "_quality", "_maybe_dropped", "a.b", "r", "found", "sha", "maybe", "h", "size", "cls", "last", "back`tick"]


@pytest.mark.parametrize("rows_", [ODD, []])
def test_stages_odd_input_and_clashing_names(spark, tmp_path, rows_):
    """Every stage takes nulls, empty and long texts, ties, repeated rows, empty tables and clashing names; extra columns stay as they are."""
    import corpus_pipeline as p

    spark.createDataFrame([(6, 1, 0), (8, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(d, t, "en", "s", 0, *(f"{c} of {d}" for c in CLASHES)) for d, t in rows_], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in CLASHES))
    before = Counter(map(tuple, docs.collect()))
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        kept = Counter(map(tuple, out.collect()))
        assert kept <= before
        texts = {r[1] or "" for r in before}
        if name == "language_id" and rows_:
            assert all(r[1] and any(c.isalpha() for c in r[1]) for r in kept)
        if name == "exact_dedup":
            assert {r[1] or "" for r in kept} == texts and sum(kept.values()) == len(texts)
        if name == "near_dedup" and rows_:
            assert Counter(r[1] for r in kept)["a b c d"] == 1 and sum(n for r, n in kept.items() if not (r[1] or "").strip()) == 4
    got = p.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert bool(got) == bool(rows_)


@pytest.mark.parametrize("labels", [[], [(None, 1, 0), (4, None, 0)], [(6, 1, 0)]])
def test_stages_without_anything_to_learn_keep_all(spark, odd, tmp_path, monkeypatch, labels):
    import corpus_pipeline as p

    monkeypatch.setattr(quality, "held_out", lambda doc_id: F.coalesce(doc_id == 6, F.lit(False)))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for stage in (p.language_id, p.quality_filter):
        assert Counter(map(str, stage(spark, odd, str(tmp_path)).collect())) == Counter(map(str, odd.collect()))


def test_pipeline_runs(spark):
    import corpus_pipeline as p

    assert p.run(spark, "/root/testdata/sf0.001").filter("length > 0").count() > 0
