"""Who works on the same files: conflicts, pairs, patterns and their course over time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Blocks of authors at least; rows (file, author) that a block has on average at most.
BLOCKS, BLOCK_ROWS = 16, 1 << 22
#: Pairs of a file's authors that are counted at once.
PAIRS = 1 << 20


def conflicts(murmurs: DataFrame, least: int = 2) -> DataFrame:
    g = murmurs.groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("author")), ",").alias("authors"), F.count_distinct("author").alias("n_authors"))
    return g.filter(F.col("n_authors") >= least)


def author_pairs(murmurs: DataFrame) -> DataFrame:
    """Files that two authors share.

    The pairs within a file are not shuffled: authors are dealt into blocks, and two blocks meet, with the authors that
    each has in a file as a list, where all pairs between them are counted. So a row (file, author) travels once for each
    block, however many authors its file has.
    """
    own = murmurs.select("file", "author").filter("file is not null and author is not null").distinct()
    blocks = own.agg(F.greatest(F.lit(BLOCKS), F.ceil(F.count("*") / BLOCK_ROWS)).alias("blocks"))
    dealt = own.crossJoin(F.broadcast(blocks)).withColumn("block", F.pmod(F.xxhash64("author"), "blocks"))
    dealt = dealt.withColumn("at", F.dense_rank().over(W.partitionBy("block").orderBy("author")) - 1)
    lists = dealt.groupBy("block", "file").agg(F.collect_list("at").alias("at"))
    left, right = (lists.select("file", F.col("block").alias(b), F.col("at").alias(a)) for b, a in (("i", "left"), ("j", "right")))
    met = left.join(right, "file").filter("i < j or (i = j and size(left) > 1)").select("i", "j", "left", "right", F.lit(None).cast("array<string>").alias("names"))
    names = dealt.groupBy("block", "blocks").agg(F.array_sort(F.collect_set("author")).alias("names")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    none = F.lit(None).cast("array<int>")
    names = names.select(F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), F.when(F.col("block") <= F.col("k"), F.array().cast("array<int>")).otherwise(none).alias("left"), none.alias("right"), "names")
    pairs = met.unionByName(names).groupBy("i", "j").applyInArrow(_shared, "a string, b string, files long")
    return pairs.select(F.least("a", "b").alias("author"), F.greatest("a", "b").alias("other"), "files")


def _shared(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two blocks (one, if they are the same): how many files each two authors share.

    Rows are a file's authors on either side, or the names of a side, the left one's with an empty list.
    """
    t = pa.Table.from_batches(list(batches)).combine_chunks()
    same, said = key[0].as_py() == key[1].as_py(), t.filter(t["names"].is_valid())
    left, right = (next((said["names"].combine_chunks()[k].values for k in range(len(said)) if said["left"][k].is_valid == first), None) for first in (True, False))
    t = t.filter(t["names"].is_null())
    if not len(t):
        return
    right = left if same else right
    sides = [t[c].combine_chunks() for c in ("left", "right")]
    a, b = (np.asarray(s.flatten()) for s in sides)
    n = [np.asarray(s.value_lengths(), np.int64) for s in sides]
    order = np.argsort(a, kind="stable")
    a, file = a[order], np.repeat(np.arange(len(t)), n[0])[order]
    start, n = (np.cumsum(n[1]) - n[1])[file], n[1][file]  # of the right authors that a left one meets in a file
    ends = np.append(np.flatnonzero(np.diff(a)) + 1, len(a))  # of each left author's files
    done = np.append(0, np.cumsum(n))
    k = 0
    while k < len(ends):
        p = ends[k - 1] if k else 0
        last = max(k, int(np.searchsorted(done[ends], done[p] + PAIRS, "right")) - 1)
        x, y, c = _counts(a, b, start, n, done, p, ends[last], a[p], int(a[ends[last] - 1] - a[p]) + 1, len(right))
        if same:
            x, y, c = (v[x < y] for v in (x, y, c))
        yield pa.RecordBatch.from_arrays([left.take(pa.array(x)), right.take(pa.array(y)), pa.array(c)], ["a", "b", "files"])
        k = last + 1


def _counts(a, b, start, n, done, p: int, q: int, base: int, rows: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left author, right author and count from the left authors' files p to q, some at a time; in a table where that isn't mostly empty."""
    full = rows * width <= 8 * max(PAIRS, done[q] - done[p])
    sums, keys = np.zeros(rows * width if full else 0, np.int64), []
    while p < q:
        stop = min(q, max(p + 1, int(np.searchsorted(done, done[p] + PAIRS, "right")) - 1))
        m = n[p:stop]
        at = np.repeat(start[p:stop] - (done[p:stop] - done[p]), m) + np.arange(done[stop] - done[p])
        key = np.repeat((a[p:stop].astype(np.int64) - base) * width, m) + b[at]
        if full:
            sums += np.bincount(key, minlength=len(sums))
        else:
            keys.append(key)
        p = stop
    if full:
        key = np.flatnonzero(sums)
        count = sums[key]
    else:
        key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key // width + base, key % width, count


def author_summary(murmurs: DataFrame) -> DataFrame:
    g = murmurs.groupBy("author").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"), F.max("sec").alias("last"), F.max_by(F.when(F.col("topic") == "click", F.col("content")), F.when(F.col("topic") == "click", F.struct("sec", "id"))).alias("wip"))
    return g


def solo_silos(murmurs: DataFrame) -> DataFrame:
    """Authors none of whose files has another author."""
    own = murmurs.select("file", "author").distinct()
    n = own.groupBy("file").agg(F.count("*").alias("n"))
    return own.join(n, "file").groupBy("author").agg(F.bool_and(F.col("n") == 1).alias("solo"), F.count("*").alias("files"))


def bridges(murmurs: DataFrame, least: int = 3) -> DataFrame:
    """Pairs of packages that only one author, of at least ``least`` packages, works in."""
    own = murmurs.select("author", F.substring_index("file", "/", 2).alias("package")).distinct()
    wide = own.groupBy("author").agg(F.count("*").alias("c")).filter(F.col("c") >= least).select("author")
    pairs = own.join(own.withColumnRenamed("package", "other"), "author").filter("package < other")
    single = pairs.groupBy("package", "other").agg(F.count("*").alias("n"), F.min("author").alias("author")).filter("n = 1")
    return single.join(wide, "author", "left_semi").select("author", "package", "other")


def velocity(murmurs: DataFrame, since: int, until: int, width: int, step: int) -> DataFrame:
    """Murmurs, conflicts and their density in windows [t, t + width) from ``since`` by ``step``; empty windows stay."""
    spark = murmurs.sparkSession
    spine = spark.range(since, until, step).select(F.col("id").alias("start"))
    n = -(-width // step)
    final = since + (until - 1 - since) // step * step  # where the last window starts
    rows = murmurs.filter((F.col("sec") >= since) & (F.col("sec") < final + width))
    last = F.least(F.floor((F.col("sec") - since) / step), F.lit((final - since) // step))
    hits = rows.withColumn("k", F.explode(F.sequence(F.greatest(F.lit(0), last - n + 1), last))).withColumn("start", since + F.col("k") * step).filter(F.col("sec") < F.col("start") + width)
    files = hits.groupBy("start", "file").agg(F.count("*").alias("n"), F.count_distinct("author").alias("a"))
    g = files.groupBy("start").agg(F.sum("n").alias("murmurs"), F.sum((F.col("a") > 1).cast("long")).alias("conflicts"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return spine.join(g, "start", "left").select("start", z("murmurs"), z("conflicts"), F.round(F.when(F.coalesce("murmurs", F.lit(0)) > 0, F.col("conflicts") / F.col("murmurs")).otherwise(0.0), 6).alias("density"))


def escalating(points: DataFrame, n: int = 3) -> DataFrame:
    """Whether the conflicts of the last ``n`` windows that aren't empty rise strictly. One row for each window, of which there are few."""
    w = W.orderBy("start")
    rows = points.filter("murmurs > 0").withColumn("rise", F.col("conflicts") > F.lag("conflicts").over(w)).withColumn("back", F.row_number().over(W.orderBy(F.desc("start"))))
    return rows.filter(F.col("back") <= n).agg((F.bool_and(F.when(F.col("back") < n, F.col("rise")).otherwise(True)) & (F.count("*") == n)).alias("escalating"))


def last_per_key(murmurs: DataFrame, n: int = 5) -> DataFrame:
    """The latest ``n`` of each author."""
    return murmurs.withColumn("back", F.row_number().over(W.partitionBy("author").orderBy(F.desc("sec"), F.desc("id")))).filter(F.col("back") <= n).select("author", "id", "back")


def page(murmurs: DataFrame, before: int, before_id: int, limit: int = 50) -> DataFrame:
    """Keyset page by (time, id), with one more row to tell whether there are more."""
    rows = murmurs.filter((F.col("sec") < before) | ((F.col("sec") == before) & (F.col("id") < before_id)))
    return rows.orderBy(F.desc("sec"), F.desc("id")).limit(limit + 1).select("id", "sec", "author")


def silences(murmurs: DataFrame, topic: str, quiet: int) -> DataFrame:
    """Batch form of the silence detector: a match is confirmed if its author is silent for ``quiet`` seconds after it."""
    nxt = F.lead("sec").over(W.partitionBy("author").orderBy("sec", "id"))
    return murmurs.withColumn("next", nxt).filter((F.col("topic") == topic) & (F.col("next").isNull() | (F.col("next") - F.col("sec") >= quiet))).select("author", "id", "sec")


def histogram(murmurs: DataFrame, bounds: list[float]) -> DataFrame:
    """Counts up to each bound (inclusive) and above all."""
    bucket = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        bucket = F.when(F.col("value") <= bounds[i], i).otherwise(bucket)
    return murmurs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("sum"))
