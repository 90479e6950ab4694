"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

The statistics come from a text's bytes, words and lines. The trees are grown level by level on
histograms of at most ``BINS`` bins a statistic, from a sample of at most about ``SAMPLE`` labelled
documents, and kept as flat arrays that numpy walks for all rows and trees at once.

Defined cases: a null text counts as empty and has a score like any other. A document with several
labels counts with the highest; null labels are left out. Without labels to learn from
(none, or of held-out documents alone) every score is 0.5 and the trees are not ``learned``, so that a
filter can let all documents pass. Repeated rows get equal scores; very long texts are read whole;
empty tables give no rows; extra columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import held_out

BINS = 64
#: Bound of the labelled rows that the trees are fitted on.
SAMPLE = 20_000
KEEP = 0.7

_GROUPS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": [32, 9], "newline": [10],
    "stop": [46], "comma": [44], "bar": [124], "mark": [33, 63], "symbol": [*b"#$%&*@^~=+_<>{}[]\\"], "quote": [34, 39], "other": range(128, 256),
}
_MASKS = np.array([[b in g for b in range(256)] for g in _GROUPS.values()], np.float64).T


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = hist[hist > 0] / n
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    distinct = set(words)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), *(hist @ _MASKS / n), float(-(p * np.log2(p)).sum()) if len(raw) else 0.0,
        float(sizes.mean()), float(sizes.std()), float(np.log1p(sizes.max())), float((sizes <= 3).mean()),
        len(distinct) / max(1, len(words)), len(set(lines)) / max(1, len(lines)), float(np.log1p(len(raw) / max(1, len(lines)))),
        sum(map(bytes.isupper, words)) / max(1, len(words)), sum(map(bytes.isalpha, words)) / max(1, len(words)),
    ]


@dataclass
class Trees:
    """Full binary trees of one depth; inner nodes and leaves in level order, a row for each tree."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float
    learned: bool = True

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        if len(self.feature):
            depth, tree = int(np.log2(self.leaf.shape[1])), np.arange(len(self.feature))
            for i in range(0, len(x), 4096):
                part = x[i : i + 4096]
                row, node = np.arange(len(part))[:, None], np.zeros((len(part), len(tree)), np.int64)
                for _ in range(depth):
                    node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.cut[tree, node])
                out[i : i + 4096] += self.leaf[tree, node - (self.leaf.shape[1] - 1)].sum(1)
        return 1 / (1 + np.exp(-out))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, ridge: float = 1.0) -> Trees:
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y) or y.min() == y.max():
        start = 0.0 if not len(y) else (3.0 if y[0] else -3.0)
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), start, bool(len(y)))
    features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)  # bin b: x > edge b - 1
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(x), start)
    out = Trees(np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), start)
    flat = binned + np.arange(features) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            width = 2**level
            at = (node[:, None] * features * BINS + flat).ravel()
            size = width * features * BINS
            hg = np.bincount(at, np.repeat(g, features), size).reshape(width, features, BINS).cumsum(2)
            hh = np.bincount(at, np.repeat(h, features), size).reshape(width, features, BINS).cumsum(2)
            ag, ah = hg[:, :, -1:], hh[:, :, -1:]
            gain = hg**2 / (hh + ridge) + (ag - hg) ** 2 / (ah - hh + ridge) - ag**2 / (ah + ridge)
            gain[(hh < 1) | (ah - hh < 1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    out.feature[t, width - 1 + k], out.cut[t, width - 1 + k] = f, edges[f][b]
            node = 2 * node + (x[np.arange(len(x)), out.feature[t, width - 1 + node]] > out.cut[t, width - 1 + node])
        sg, sh = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        out.leaf[t] = -rate * sg / (sh + ridge)
        margin += out.leaf[t][node]
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Learns from labels of documents that aren't held out."""
    own = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("label"))
    total = own.count()
    drawn = own.filter(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) < (1 << 20) * min(1.0, sample / max(1, total)))

    @F.pandas_udf("binary")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([np.array(statistics(t or "")).tobytes() for t in text])

    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "label", run("text").alias("x"))
    rows = rows.groupBy("doc_id", "label").agg(F.min("x").alias("x"))  # of rows with one id, the least statistics
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * max(sample, 1000))
    rows = sorted(rows.collect())  # the bounded sample, in one order
    return grow(np.frombuffer(b"".join(r.x for r in rows)).reshape(len(rows), -1) if rows else np.zeros((0, 0)), np.array([float(r.label > 0) for r in rows]))


def score(text: Column, trees: Trees) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(trees.score(np.array([statistics(t or "") for t in x])) if len(x) else np.zeros(0))

    return run(text)
