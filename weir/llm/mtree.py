"""Exact top-k search by inner product with M-trees.

Vectors are dealt into blocks by the nearest of at most ``PIVOTS`` pivots, and the vectors of a pivot by
hash where they are more than a block holds; each block gets an M-tree whose nodes are pages: a routing
object, the covering radius of all that lies below it and the distance to the parent's routing object
for each entry. To make the largest inner product the nearest neighbour, every stored vector gets one
more component, sqrt(M^2 - |v|^2) with M the block's largest norm, and a query a zero there; then
d^2 = |q|^2 + M^2 - 2 q.v.

A search is best-first by the least distance that a page can hold. An entry is passed over without
computing its distance when |d(q, parent) - d(entry, parent)| - radius already exceeds the k-th best
distance. A query first asks a block of its own pivot; the k-th best score from there is a bound, with
which it asks only those other blocks whose ball around the pivot can hold a better one: q.p + |q| r.
Bounds have a slack far above rounding, so ties are never lost. A block's pages are sent once for each
``QUERIES`` queries that ask it.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do
rows without an id. Vectors meet only those with as many components. A query never finds rows with its
own id. Rows with equal ids and vectors are each found; of query rows with one id, the least vector is
asked. Ties go to the smaller id. Scores are exact integers as long as the product of two vectors'
norms stays below 2^53. Empty tables give no rows; extra columns don't matter.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weir.llm.common import materialise

BLOCK, QUERIES, PAGE, FANOUT, PIVOTS = 8192, 1024, 256, 16, 4096
SLACK = 1e-3
PAGES = "dim int, block long, page int, leaf boolean, norm double, ids array<long>, vectors binary, radius array<double>, to_parent array<double>, child array<int>"


def build(ids: np.ndarray, x: np.ndarray) -> list[dict]:
    """Pages of the M-tree over the rows of ``x``; page 0 is the root."""
    square = (x * x).sum(1)
    norm = float(square.max())
    v = np.hstack([x, np.sqrt(np.maximum(norm - square, 0))[:, None]])
    rng, pages = np.random.default_rng(1), []

    def page(own: np.ndarray, parent: int | None) -> int:
        number = len(pages)
        pages.append({})
        if len(own) <= PAGE:
            at, radius, child = own, np.zeros(len(own)), []
        else:
            at = rng.choice(own, min(FANOUT, -(-len(own) // PAGE)), replace=False)
            d = np.stack([np.linalg.norm(v[own] - v[p], axis=1) for p in at])
            near = d.argmin(0)
            if np.bincount(near).max() == len(own):  # equal vectors: any split will do
                near = np.arange(len(own)) % len(at)
            used = [k for k in range(len(at)) if (near == k).any()]
            radius = np.array([d[k][near == k].max() for k in used])
            child = [page(own[near == k], int(at[k])) for k in used]
            at = at[used]
        to_parent = np.linalg.norm(v[at] - v[parent], axis=1) if parent is not None else np.zeros(len(at))
        pages[number] = {"page": number, "leaf": not child, "norm": norm, "ids": ids[at].tolist(), "vectors": x[at].astype(np.int64).tobytes(), "radius": radius.tolist(), "to_parent": to_parent.tolist(), "child": child}
        return number

    page(np.arange(len(ids)), None)
    return pages


class MTree:
    def __init__(self, pages: pd.DataFrame, dim: int):
        self.norm = float(pages["norm"].iloc[0])
        self.pages = {
            int(r.page): (r.leaf, np.array(r.ids), np.frombuffer(r.vectors, np.int64).reshape(-1, dim).astype(np.float64), np.array(r.radius), np.array(r.to_parent), np.array(r.child, int))
            for r in pages.itertuples()
        }

    def search(self, own: int, q: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, best first; those below the score ``least`` may be missing."""
        base = float(q @ q) + self.norm
        found_id, found = np.empty(0, np.int64), np.empty(0)
        bound = np.inf if np.isinf(least) else float(np.sqrt(max(0.0, base - 2 * least)))
        heap = [(0.0, 0, None)]
        while heap:
            least, number, parent = heapq.heappop(heap)
            if least > bound + SLACK:
                break
            leaf, ids, x, radius, to_parent, child = self.pages[number]
            maybe = np.ones(len(ids), bool) if parent is None else np.abs(parent - to_parent) - radius <= bound + SLACK
            score = x[maybe] @ q
            if leaf:
                new = ids[maybe] != own
                found_id, found = np.concatenate([found_id, ids[maybe][new]]), np.concatenate([found, score[new]])
                if len(found) > k:
                    top = np.lexsort((found_id, -found))[:k]
                    found_id, found = found_id[top], found[top]
                if len(found) == k:
                    bound = min(bound, float(np.sqrt(max(0.0, base - 2 * found.min()))))
            else:
                d = np.sqrt(np.maximum(base - 2 * score, 0))
                for dist, r, c in zip(d, radius[maybe], child[maybe], strict=True):
                    if dist - r <= bound + SLACK:
                        heapq.heappush(heap, (max(0.0, dist - r), int(c), dist))
        top = np.lexsort((found_id, -found))[:k]
        return found_id[top], found[top]


def usable(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v (floor of each component times ``scale``), dim."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"), F.size("embedding").alias("dim"))


def _near(pivots: dict[int, np.ndarray]):
    """A column function (v, dim): the number of the nearest pivot of that dimension and the distance to it."""

    @F.pandas_udf("struct<pivot: int, far: double>")
    def run(v: pd.Series, dim: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"pivot": np.zeros(len(v), np.int32), "far": np.zeros(len(v))}, index=v.index)
        for d, own in v.groupby(dim):
            p, x = pivots.get(int(d)), np.array(own.tolist(), np.float64)
            if p is None:  # too few vectors have this dimension for one to be drawn
                out.loc[own.index, "far"] = np.inf
                continue
            for i in range(0, len(x), 1024):
                apart = np.sqrt(np.maximum(0, (x[i : i + 1024] ** 2).sum(1)[:, None] - 2 * x[i : i + 1024] @ p.T + (p**2).sum(1)))
                out.loc[own.index[i : i + 1024], "pivot"] = apart.argmin(1).astype(np.int32)
                out.loc[own.index[i : i + 1024], "far"] = apart.min(1)
        return out

    return run


def top_k(data: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score. ``data`` and ``queries`` as ``usable`` gives them."""
    wanted = min(PIVOTS, max(1, -(-data.count() // BLOCK)))
    drawn = data.select("dim", "v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(wanted).collect()
    pivots = {d: np.array([r.v for r in drawn if r.dim == d], np.float64) for d in {r.dim for r in drawn}}
    near = _near(pivots)
    # Of equal rows k are enough, and they are put together before they are dealt.
    rows = data.groupBy("vec_id", "dim", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    placed = materialise(rows.select("vec_id", "dim", "v", F.explode(F.sequence(F.lit(1), "n")).alias("copy"), near("v", "dim").alias("near")))
    sizes = placed.groupBy("dim", "near.pivot").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    sizes = sizes.withColumn("first", F.sum("parts").over(W.orderBy("dim", "pivot")) - F.col("parts"))  # a row for each pivot
    sizes = materialise(sizes)
    block = (F.col("first") + F.pmod(F.xxhash64("vec_id", "v", "copy"), "parts")).alias("block")
    dealt = placed.select("*", "near.pivot").join(F.broadcast(sizes), ["dim", "pivot"]).select("vec_id", "v", "dim", "pivot", "near.far", block)
    balls = dealt.groupBy("dim", "pivot", "block").agg(F.max("far").alias("radius")).collect()  # a row for each block
    radii = {d: [(r.block, r.pivot, r.radius) for r in balls if r.dim == d] for d in {r.dim for r in balls}}
    shared = data.sparkSession.sparkContext.broadcast({d: (np.array([x[0] for x in own]), pivots.get(d), np.array([x[1] for x in own]), np.array([x[2] for x in own])) for d, own in radii.items()})

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        pages = build(pdf["vec_id"].to_numpy(), np.array(pdf["v"].tolist(), np.float64))
        return pd.DataFrame(pages).assign(dim=pdf["dim"].iloc[0], block=pdf["block"].iloc[0])[[c.split()[0] for c in PAGES.split(", ")]]

    index = materialise(dealt.groupBy("dim", "block").applyInPandas(plant, PAGES))

    def answer(pages: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pages) and len(own):
            tree = MTree(pages, int(pages["dim"].iloc[0]))
            for q, v, least in zip(own["vec_id"], own["v"], own["least"], strict=True):
                ids, scores = tree.search(q, np.array(v, np.float64), k, -np.inf if pd.isna(least) else least)
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids, "score": scores.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    def ask(asked: DataFrame) -> DataFrame:
        """asked: vec_id, v, dim, block, least."""
        sets = asked.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).alias("sets"))
        asked = materialise(asked.join(sets, "block").withColumn("set", F.pmod(F.xxhash64("vec_id"), "sets")))
        every = index.join(asked.select(F.col("block").alias("to"), F.col("set").alias("part")).distinct(), F.col("block") == F.col("to"))
        return every.groupBy("to", "part").cogroup(asked.groupBy("block", "set")).applyInPandas(answer, "query_id long, vec_id long, score long")

    @F.pandas_udf("array<long>")
    def others(v: pd.Series, dim: pd.Series, least: pd.Series, asked: pd.Series) -> pd.Series:
        out = []
        for x, d, bound, done in zip(v, dim, least, asked, strict=True):
            blocks, centres, of, radius = shared.value[int(d)] if int(d) in shared.value else (np.empty(0, np.int64), None, None, None)
            maybe = blocks != done
            if not pd.isna(bound) and centres is not None:
                q = np.array(x, np.float64)
                size = np.sqrt(q @ q)
                most = (centres @ q)[of] + size * radius
                maybe &= most + 1 + 1e-9 * size * (radius + np.sqrt((centres**2).sum(1))[of]) >= bound
            out.append(blocks[maybe].tolist())
        return pd.Series(out, dtype=object)

    asked = queries.groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    asked = asked.select("*", near("v", "dim")["pivot"].alias("pivot")).join(F.broadcast(sizes), ["dim", "pivot"], "left")
    asked = materialise(asked.select("vec_id", "v", "dim", (F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts")).alias("block")))
    first = materialise(ask(asked.filter("block is not null").withColumn("least", F.lit(None).cast("double"))))
    bound = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), F.col("least").cast("double").alias("least"))
    rest = asked.join(bound, "vec_id", "left").withColumn("to", others("v", "dim", "least", F.coalesce("block", F.lit(-1))))
    second = ask(rest.select("vec_id", "v", "dim", F.explode("to").alias("block"), "least"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.unionByName(second).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
