"""A written full-text index: postings by hash of the term, with positions; searches that read only their terms' partitions.

``build`` reads the texts once. A posting is a term, a text's id, how often and where the term occurs in it
and how many words the text has, so that ranking needs nothing else. Postings are dealt by the hash of
their term into ``BUCKETS`` folders and, within one, by id into ``SPREAD`` parts, so that a word of all
texts makes no task of its own; within a file they are sorted by term, and a search's terms reach the
scan as partition and row-group filters. Searches return ids, which meet rows and filters by joins on ids.
Texts that come later are a segment of their own, texts that go a list of ids; both take effect at once
and leave what is written as it is.

Words are runs of a-z, 0-9 and _ in the lower-cased text. Null texts have no words. Ids must be unique.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.tables import shared_folder

BUCKETS, SPREAD = 64, 8
POSTINGS = "term string, id long, tf int, len int, positions array<int>"
STORED = POSTINGS + ", segment int, bucket int"
REMOVED = "id long, len int, step int"
_WORD = re.compile("[a-z0-9_]+")


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass
class Index:
    """Where an index is, and what ranking needs of all its texts."""

    spark: SparkSession
    path: str
    buckets: int
    texts: int
    mean: float
    segments: list[int]
    removals: bool

    def postings(self, terms: list[str]) -> DataFrame:
        """The postings of some terms: the scan is of their buckets in the segments that are whole."""
        # The driver computes the few terms' buckets, so that the scan has them as constants.
        here = self.spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"), self.buckets).alias("b"))
        rows = self.spark.read.schema(STORED).parquet(f"{self.path}/postings") if self.segments else self.spark.createDataFrame([], STORED)
        rows = rows.filter(F.col("segment").isin(self.segments) & F.col("bucket").isin([r.b for r in here.distinct().collect()]) & F.col("term").isin(terms))
        if self.removals:
            gone = self.spark.read.schema(REMOVED).parquet(f"{self.path}/removed").filter(F.col("step").isin(self.segments)).groupBy(F.col("id").alias("gone")).agg(F.max("step").alias("since"))
            rows = rows.join(gone, (F.col("id") == F.col("gone")) & (F.col("segment") < F.col("since")), "left_anti")
        return rows.drop("bucket", "segment")


def _postings(batches: Iterator[pa.RecordBatch]):
    """A row for each term of each text; an empty term stands for the text itself."""
    for whole in batches:
        for i in range(0, whole.num_rows, 64):
            b = whole.slice(i, 64)
            terms, ids, lens, places = [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at: dict[str, list[int]] = {}
                n = 0
                for n, m in enumerate(_WORD.finditer(text or ""), 1):
                    at.setdefault(m.group(), []).append(n)
                terms += ["", *at]
                places += [[], *at.values()]
                ids += [key] * (len(at) + 1)
                lens += [n] * (len(at) + 1)
            sizes = np.array([len(p) for p in places], np.int32)
            flat = pa.array([x for p in places for x in p], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(ids, pa.int64()), pa.array(sizes), pa.array(lens, pa.int32()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)], ["term", "id", "tf", "len", "positions"])


def build(docs: DataFrame, path: str | None = None, buckets: int = BUCKETS, spread: int = SPREAD) -> Index:
    """Writes the index of texts (id, content) to ``path``, by default a folder of its own in the shared one."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/index-{uuid.uuid4()}"
    return added(Index(spark, path, buckets, 0, 0.0, [], False), docs, spread)


def added(index: Index, docs: DataFrame, spread: int = SPREAD) -> Index:
    """The index with more texts, as a segment of its own; ids that it has already must be removed before.

    A segment counts once its figures are written, so one that failed is never seen and is written again
    in the same place.
    """
    step = max(index.segments, default=-1) + 1
    rows = docs.select(F.col("id").cast("long"), F.lower("content")).mapInArrow(_postings, POSTINGS)
    rows = rows.withColumns({"bucket": bucket_of(F.col("term"), index.buckets), "part": F.pmod(F.xxhash64("id"), F.lit(spread))})
    rows = rows.repartition(F.col("bucket"), F.col("part")).drop("part").sortWithinPartitions("bucket", "term", "id")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/postings/segment={step}")
    own = index.spark.read.schema(STORED).parquet(f"{index.path}/postings").filter((F.col("segment") == step) & (F.col("term") == "") & (F.col("bucket") == bucket_of(F.lit(""), index.buckets)))
    _figures(index, step, own)
    return opened(index.spark, index.path)


def removed(index: Index, ids: DataFrame) -> Index:
    """The index without some texts (id); they may be added again, with other words, after that."""
    step = max(index.segments, default=-1) + 1
    known = index.postings([""]).join(ids.select(F.col("id").cast("long")).distinct(), "id", "left_semi")
    known.select("id", "len").write.mode("overwrite").parquet(f"{index.path}/removed/step={step}")
    _figures(index, step, index.spark.read.schema("id long, len int").parquet(f"{index.path}/removed/step={step}"), -1)
    return opened(index.spark, index.path)


def _figures(index: Index, step: int, texts: DataFrame, sign: int = 1) -> None:
    total = texts.agg((F.count("*") * sign).alias("texts"), (F.coalesce(F.sum(F.col("len").cast("long")), F.lit(0)) * sign).alias("words"), F.lit(index.buckets).alias("buckets"))
    total.coalesce(1).write.mode("overwrite").parquet(f"{index.path}/figures/segment={step}")


def opened(spark: SparkSession, path: str) -> Index:
    """An index that is already written."""
    steps = spark.read.schema("texts long, words long, buckets int, segment int").parquet(f"{path}/figures").collect()  # a row for each segment
    texts, words = sum(r.texts for r in steps), sum(r.words for r in steps)
    return Index(spark, path, steps[0].buckets, texts, words / texts if texts else 0.0, sorted(r.segment for r in steps), any(r.texts < 0 for r in steps))


def _terms(words: str | list[str]) -> list[str]:
    found = _WORD.findall(words.lower()) if isinstance(words, str) else words
    if not found:
        raise ValueError("a search needs a word")
    return found


def ranked(index: Index, words: str | list[str], k: int | None = 20, every: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score: texts with any of the words (with ``every``: all of them) by BM25, best first; all without ``k``."""
    terms = list(dict.fromkeys(_terms(words)))
    rows = index.postings(terms)
    counts = rows.groupBy("term").agg(F.count("*").alias("df"))  # a row for each word of the search
    idf = F.log(1 + (F.lit(index.texts) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(index.mean or 1.0)))
    found = rows.join(F.broadcast(counts), "term").groupBy("id").agg(F.round(F.sum(part), 4).alias("score"), F.count("*").alias("met"))
    found = found.filter(F.col("met") == len(terms)) if every else found
    found = found.select("id", "score").orderBy(F.desc("score"), "id")
    return found if k is None else found.limit(k)


def phrase(index: Index, words: str | list[str]) -> DataFrame:
    """id, hits, first: texts that have the words one right after the other, how often, and the number of the first such word (from 1)."""
    terms = _terms(words)
    starts = index.postings(list(dict.fromkeys(terms)))
    # Where a phrase would start by each of its words: a word that it has twice counts at both places.
    own = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(i).alias("i")) for i, t in enumerate(terms)))
    at = F.flatten(F.transform(F.filter(own, lambda x: x["term"] == F.col("term")), lambda x: F.transform("positions", lambda p: p - x["i"])))
    votes = starts.select("id", F.explode(at).alias("start")).groupBy("id", "start").agg(F.count("*").alias("n"))
    return votes.filter(F.col("n") == len(terms)).groupBy("id").agg(F.count("*").alias("hits"), F.min("start").alias("first"))


def hits(index: Index, words: str | list[str], rows: DataFrame, k: int | None = None, every: bool = False) -> DataFrame:
    """The rows (id, ...) that a search finds, with their score: the ranked ids meet what is known of them."""
    found = ranked(index, words, k, every)
    return rows.join(found, "id")


def filtered(index: Index, words: str | list[str], rows: DataFrame, k: int = 20, every: bool = False) -> DataFrame:
    """id, score: the best among those that ``rows`` (id, ...), already filtered, has too."""
    found = ranked(index, words, None, every)
    return found.join(rows.select("id").distinct(), "id", "left_semi").orderBy(F.desc("score"), "id").limit(k)
