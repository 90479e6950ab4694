"""Hard-negative mining with exact scores from matrix products in a residue number system.

Scores are integer inner products. The component matrices are reduced modulo primes below 2^10, each
residue matrix is multiplied in float32 over at most ``STEP`` components at a time, where no sum passes
2^24 and so none is rounded, and the scores are put together by Chinese remaindering with signs. A task
takes as many primes as the product of its longest two vectors asks for.

Anchors meet the other rows in blocks: rows are dealt into lanes of about ``LANE`` rows and anchors into
sets of about ``SET``, and one task works on one lane and one set. First, within each label, the best rows
of every lane give an anchor's positives. Then, in lanes of all labels, every score of a set and a lane is
sorted once, and for each positive the window of admissible scores is a slice of it; the lanes' slices
are merged by a window. A label or a vector that holds a third of all rows is spread over lanes like
any other rows.

Defined cases: rows without an id or a label and vectors that are null, empty or hold null or non-finite
components take no part. Vectors meet only those with as many components. A row never meets rows with its
own id; of anchor rows with one id, one of the least label and of the fewest components is taken. Repeated rows
are each found. Components and scores beyond 64 bits become the nearest 64-bit number. A positive score
below 0 admits nothing, one of 0 only 0. Empty tables give no rows; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weir.llm.common import join_groups, materialise

LANE, SET = 8192, 16384
#: Scores that a task holds at a time.
AT_ONCE = 1 << 20
#: Components whose products of two residues sum to less than 2^24.
STEP = 64
PRIMES = [p for p in range(1023, 500, -2) if all(p % q for q in range(3, 32, 2))]
#: Products of primes up to here fit the reconstruction and the sorted keys in 64 bits.
NARROW = 1 << 46
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def primes_for(bound: int) -> list[int]:
    """The fewest primes whose product tells all numbers from -bound to bound apart."""
    product, k = 1, 0
    while product <= 2 * bound:
        product, k = product * PRIMES[k], k + 1
    return PRIMES[:k]


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Of least absolute value, as float32."""
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact product a b^T of matrices of 64-bit numbers; 64-bit where they suffice, else Python's."""
    longest = [float((x.astype(np.float64) ** 2).sum(1).max(initial=0)) ** 0.5 for x in (a, b)]
    primes = primes_for(int(longest[0] * longest[1] * (1 + 1e-9)) + 1)
    product = int(np.prod(primes, dtype=object))
    wide = product >= NARROW
    total, modulus = np.zeros((len(a), len(b)), object if wide else np.int64), 1
    for p in primes:
        ra, rb = residues(a, p), residues(b, p)
        found = np.zeros(total.shape, np.int32)
        for i in range(0, a.shape[1], STEP):
            found += (ra[:, i : i + STEP] @ rb[:, i : i + STEP].T).astype(np.int32) % p
        # The next digit in mixed radix: total + modulus * digit has the residue found.
        digit = (found - (total % p).astype(np.int32)) % p * pow(modulus, -1, p) % p
        total += modulus * digit.astype(object if wide else np.int64)
        modulus *= p
    return np.where(total > product // 2, total - product, total)


def usable(vectors: DataFrame, scale: int, label: Column) -> DataFrame:
    """vec_id, label, dim, v: the floor of each component times ``scale``, as packed numbers of 2, 4 or 8 bytes; row: a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            vec = b.column(2)
            size = pc.list_value_length(vec).to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.floor(vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            ends = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            good = bad[ends] == bad[ends - size]
            x = np.where(np.isfinite(x), x, 0)
            v = np.where(x >= 2.0**63, MOST, np.where(x < -(2.0**63), LEAST, np.where(np.abs(x) < 2.0**63, x, 0).astype(np.int64)))
            far = int(np.abs(x).max(initial=0))
            v = v.astype(np.int16 if far < 1 << 15 else np.int32 if far < 1 << 31 else np.int64)
            offsets = np.concatenate([[0], ends]) * v.itemsize
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(v.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int32()), packed], ["vec_id", "label", "dim", "v"]).filter(pa.array(good))

    rows = vectors.select("vec_id", label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0))
    return rows.mapInArrow(run, "vec_id long, label long, dim int, v binary").withColumn("row", F.monotonically_increasing_id())


def matrix(v: pd.Series, dim: int) -> np.ndarray:
    """The rows' numbers; they may be packed in different widths."""
    if v.map(len).nunique() == 1:
        return np.frombuffer(b"".join(v), f"<i{len(v.iloc[0]) // dim}").reshape(-1, dim).astype(np.int64)
    return np.stack([np.frombuffer(x, f"<i{len(x) // dim}").astype(np.int64) for x in v])


def ordered(own: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For parts of the anchors ``own``: the part, scores with all rows from best to worst, and their places in ``rows``.

    ``rows`` must be sorted by id, so that ties go to the smaller id.
    """
    dim, n = int(own["dim"].iloc[0]), len(rows)
    b, step = matrix(rows["v"], dim), max(1, AT_ONCE // n)
    for i in range(0, len(own), step):
        scores = multiply(matrix(own["v"].iloc[i : i + step], dim), b)
        if scores.dtype == object:
            scores = np.minimum(np.maximum(scores, LEAST), MOST)
        keys = -np.sort(-(scores * n + np.arange(n)[::-1]), axis=1)
        yield slice(i, i + step), (keys // n).astype(np.int64), (n - 1 - keys % n).astype(np.int64)


class Wanted:
    """The true places of each row of a matrix, in order."""

    def __init__(self, mask: np.ndarray):
        self.before = np.cumsum(mask, axis=1, dtype=np.int32)
        self.count = self.before[:, -1].astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.place = np.append(np.nonzero(mask)[1], 0)

    def next(self, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of up to k true places of each row from its place ``start`` on."""
        passed = np.where(start > 0, self.before[np.arange(len(start)), start - 1], 0)
        nth = passed[:, None] + np.arange(k)
        row, j = np.nonzero(nth < self.count[:, None])
        return row, self.place[self.first[row] + nth[row, j]]


def meet(rows: DataFrame, asked: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """``work(rows of a lane, anchors of a set)`` for every lane and set that have equal keys."""
    total = rows.count()
    asked = asked.select(*(F.col(c).alias(c) for c in asked.columns))  # both may come from one table
    sizes = asked.groupBy(*keys).agg(F.ceil(F.count("*") / SET).alias("sets")).join(rows.groupBy(*keys).agg(F.count("*").alias("size")), keys).withColumn("lanes", F.ceil(F.col("size") / LANE))
    sizes = materialise(sizes)
    lane, part = F.pmod(F.xxhash64("row"), F.col("lanes")), F.pmod(F.xxhash64("row"), F.col("sets"))
    left = join_groups(rows, sizes, keys, "size", total).withColumns({"lane": lane, "part": F.explode(F.sequence(F.lit(0).cast("long"), F.col("sets") - 1))}).drop("size", "lanes", "sets")
    right = join_groups(asked, sizes, keys, "size", total).withColumns({"part": part, "lane": F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1))}).drop("size", "lanes", "sets")
    by = [*keys, "lane", "part"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(work, schema)


def mine(data: DataFrame, anchors: DataFrame, positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, place (of the positive, from 1).

    ``data`` as ``usable`` gives it, written once; ``anchors`` are rows of it. Negatives score from
    ``low`` to ``high`` per cent of the positive.
    """
    asked = materialise(anchors.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "v", "row")).alias("a")).select("vec_id", "a.*"))

    def best(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"anchor": [], "positive_id": [], "score": []}, dtype=np.int64)]
        if len(rows) and len(own):
            rows = rows.sort_values("vec_id", kind="stable")
            ids = rows["vec_id"].to_numpy()
            for part, scores, at in ordered(own, rows):
                some = own.iloc[part]
                a, p = Wanted(ids[at] != some["vec_id"].to_numpy()[:, None]).next(np.zeros(len(some), np.int64), positives)
                out.append(pd.DataFrame({"anchor": some["row"].to_numpy()[a], "positive_id": ids[at[a, p]], "score": scores[a, p]}))
        return pd.concat(out)

    found = meet(data, asked, ["dim", "label"], best, "anchor long, positive_id long, score long")
    place = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "positive_id")).alias("place")
    found = found.select("*", place).filter(F.col("place") <= positives)
    own = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "score"))).alias("p"))  # ``positives`` at most
    own = own.select(F.col("anchor").alias("row"), F.col("p.positive_id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    asked = materialise(asked.join(own, "row"))

    def window(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: [] for c in ("anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score")}, dtype=np.int64)]
        if len(rows) and len(own):
            rows = rows.sort_values("vec_id", kind="stable")
            ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            for part, scores, at in ordered(own, rows):
                some = own.iloc[part]
                wanted = Wanted((labels[at] != some["label"].to_numpy()[:, None]) & (ids[at] != some["vec_id"].to_numpy()[:, None]))
                anchor, pid, targets = some["vec_id"].to_numpy(), some["positive_id"].tolist(), some["positive_score"].tolist()
                for j in range(positives):
                    has = np.array([j < len(t) for t in targets])
                    target = [int(t[j]) if j < len(t) else 0 for t in targets]
                    top, bottom = np.array([high * t // 100 for t in target]), np.array([-(-low * t // 100) for t in target])
                    a, p = wanted.next((scores > top[:, None]).sum(1), k)
                    good = has[a] & (scores[a, p] >= bottom[a])
                    a, p = a[good], p[good]
                    positive = np.array([x[j] if j < len(x) else 0 for x in pid], np.int64)
                    out.append(pd.DataFrame({"anchor_id": anchor[a], "place": j + 1, "positive_id": positive[a], "positive_score": np.array(target)[a], "negative_id": ids[at[a, p]], "negative_score": scores[a, p]}))
        return pd.concat(out)

    negatives = meet(data, asked, ["dim"], window, "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(W.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")).alias("rank")
    return negatives.select("*", rank).filter(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "place")
