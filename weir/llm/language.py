"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text's subwords are the runs of two to four bytes of its lower-cased UTF-8, word borders included,
hashed into ``BUCKETS``. The mean of their embeddings goes through a linear softmax. Both layers are
trained by stochastic gradient descent in numpy on a sample of at most about ``SAMPLE`` labelled
documents (whole texts as counts of buckets) that has an equal share of every language, however rare.
A fifth of the sample of each language is kept apart to fit the temperature and the score below which
a prediction is rejected; where no language has five documents, nothing is rejected for its score.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected. Without any
labelled document all are ``und``. More than ``SAMPLE`` different languages are an error. Rows are independent, so repeated rows get equal results; null ids
stay; very long texts are read whole; empty tables give no rows; extra columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import held_out

BUCKETS = 1 << 12
#: Bound of the labelled rows that the model is fitted on.
SAMPLE = 3000
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
PIECE = 1 << 20


def counts(text: str) -> np.ndarray:
    """Counts of a text's subwords by bucket; a long text goes through in pieces."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(BUCKETS)
    for i in range(0, len(b), PIECE):
        p = b[max(0, i - 3) : i + PIECE].astype(np.int64)
        h = p
        for n in range(2, 5):
            if len(h) < 2:
                break
            h = h[:-1] * 257 + p[n - 1 :]
            fresh = h if i == 0 else h[max(0, 4 - n) :]  # grams that end in this piece
            out += np.bincount(((fresh * 2654435761) >> 15) & (BUCKETS - 1), minlength=BUCKETS)
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # logits of each bucket: embeddings times weights
    temperature: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)"""
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        c = counts(text)
        p = softmax((c @ self.table / c.sum())[None] / self.temperature)[0]
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(sample: list[tuple[str, np.ndarray, np.ndarray]], dim: int = 16, epochs: int = 30, rate: float = 2.0, seed: int = 7) -> Model:
    """``sample``: (language, buckets, their counts or shares), in a fixed order. Only a batch at a time is made dense."""
    languages = sorted({lang for lang, _, _ in sample})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(lang) for lang, _, _ in sample])

    def dense(k: np.ndarray) -> np.ndarray:
        x = np.zeros((len(k), BUCKETS), np.float32)
        for row, i in enumerate(k):
            x[row, sample[i][1]] = sample[i][2] / sample[i][2].sum(dtype=np.float32)
        return x

    order = rng.permutation(len(y))
    of = [order[y[order] == k] for k in range(len(languages))]
    apart = np.concatenate([k[: len(k) // 5] for k in of])
    fit = rng.permutation(np.concatenate([k[len(k) // 5 :] for k in of]))
    e = rng.normal(0, 0.3, (BUCKETS, dim)).astype(np.float32)
    w = rng.normal(0, 0.3, (dim, len(languages))).astype(np.float32)
    scale = np.float32(np.sqrt(BUCKETS) / 8)  # a mean of many embeddings is small
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        for i in range(0, len(fit), 64):
            k = fit[i : i + 64]
            x = dense(k)
            a = x @ e * scale
            d = softmax(a @ w)
            d[np.arange(len(k)), y[k]] -= 1
            d /= len(k)
            de = x.T @ (d @ w.T) * scale
            w -= step * (a.T @ d)
            e -= step * de
        fit = rng.permutation(fit)
    table = (e @ w * scale).astype(np.float64)
    if not len(apart):
        return Model(languages, table, 1.0, 0.0)
    logits = np.concatenate([dense(apart[i : i + 64]) @ table for i in range(0, len(apart), 64)])
    right = logits.argmax(1) == y[apart]
    at = np.arange(len(apart))
    temperature = min((0.25 * 1.25**k for k in range(16)), key=lambda t: -np.log(softmax(logits / t)[at, y[apart]] + 1e-12).mean())
    scores = softmax(logits / temperature).max(1)
    threshold = min(0.5, float(np.quantile(scores[right], 0.002))) if right.any() else 0.5
    return Model(languages, table, temperature, threshold)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from text and lang of documents that aren't held out."""
    own = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = own.groupBy("lang").count().limit(sample + 1).collect()
    if not sizes:
        return train([])
    if len(sizes) > sample:
        raise ValueError(f"more than {sample} languages")
    share = sample / len(sizes)
    share += 3 * share**0.5  # so that no language's draw comes out empty by chance
    rate = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(1.0, share / r["count"]))])
    drawn = own.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 40)) < rate[F.col("lang")] * (1 << 40))

    @F.pandas_udf("binary")
    def sparse(text: pd.Series) -> pd.Series:
        return pd.Series([np.flatnonzero(c).astype(np.uint16).tobytes() + (c[c > 0] / c.sum()).astype(np.float16).tobytes() for c in map(counts, text)])

    # Rows are drawn by their values, so repeated ones come together, and one of them is taken.
    one = drawn.groupBy("lang", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.first("text").alias("text"))
    rows = one.select("lang", sparse("text").alias("c"), F.xxhash64("doc_id", "sha").alias("h")).orderBy("h", "lang", "c").limit(2 * max(sample, 1000)).drop("h")
    rows = sorted(rows.collect())  # the bounded sample, in one order
    return train([(r.lang, np.frombuffer(r.c, np.uint16, len(r.c) // 4), np.frombuffer(r.c, np.float16, offset=len(r.c) // 2)) for r in rows])


def predict(text: Column, model: Model) -> Column:
    """Struct of lang_pred, score and rejected."""

    @F.pandas_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in x], columns=["lang_pred", "score", "rejected"])

    return run(text)
