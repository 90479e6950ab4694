"""Ranked lexical search with bit-sliced Bloom signatures and exact rescoring.

Every document gets a Bloom signature of its terms, with further keys for terms that occur at least 2, 4, 8, ...
times. Documents with signatures of one width are put together in blocks, stored by slices: for each
bit of the signature a bitmap of the block's documents. The slices of a term's bits, met, tell which
documents may hold it and how often at most; with the document's length this bounds what the term can
add to the score, and the sum over an item's terms, a product of the weights with these bounds, is an
upper bound of each document's score.

A search scores the documents of the highest bounds exactly; the k-th best of these is a bound from below.
All documents whose upper bound reaches it are scored exactly from their texts, so none is lost. Of
documents with equal texts, at most k (those of the least ids) can be among the k best, and only one is
scored. Items are searched in blocks of about ``PAIRS`` terms; what a block sends to the tasks is bounded
by that. Widths end at ``WIDEST`` bits: longer documents fill their signatures and are rescored more often.

The index, one written table, also has each task's counts of the documents that hold a term; a search
sums those of its own terms.

Defined cases: null and empty texts have no terms; they count in no figure and are never found. Repeated
documents are each found, those of a null doc_id after all others of the same score. Items of equal id
and text are one item, items of equal id and different texts are searched each on its own; items without
terms find nothing. Very long texts are read whole. Empty tables give no rows; extra columns don't matter.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weir.llm.common import materialise, mix, shared_folder, texts

HASHES, BITS_PER_KEY = 4, 16
NARROWEST, WIDEST = 256, 1 << 20
#: Bits of a block, and the documents that it has at most.
BLOCK, DOCUMENTS = 1 << 22, 4096
#: Documents bounded at once; terms of items searched at once; counts of terms that a task holds.
AT_ONCE, PAIRS, COUNTED = 1024, 1 << 13, 1 << 20
#: Documents scored first for each wanted one, and texts to score up to which their keys are broadcast.
PROBES, FEW = 2, 200_000
TERMS = re.compile(rb"[0-9a-z\x80-\xff]+")
INDEX = "kind string, term string, df long, width int, doc_ids array<long>, digests binary, n array<long>, most array<int>, slices binary"


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits and of all letters beyond ASCII; only A-Z are lower-cased."""
    return TERMS.findall(text.encode("utf-8", "surrogatepass").lower())


def digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def hashes(own) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))


def level_keys(h: np.ndarray, level: int) -> np.ndarray:
    """Keys of terms that occur at least 2 ** level times."""
    return mix(h + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))


def bits(keys: np.ndarray, width: int) -> np.ndarray:
    """The signature's bits of each key: a row of ``HASHES`` numbers."""
    step = (keys >> np.uint64(32)) | np.uint64(1)
    return ((keys[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(width - 1)).astype(np.int64)


def slices(width: int, signatures: list[np.ndarray]) -> np.ndarray:
    """For each bit of the signature a bitmap of the documents whose keys are given."""
    held = np.zeros((width, -(-len(signatures) // 8) * 8), bool)
    row = np.repeat(np.arange(len(signatures)), [len(s) for s in signatures])
    held[bits(np.concatenate(signatures), width), row[:, None]] = True
    return np.packbits(held, axis=1)


def index(docs: DataFrame) -> DataFrame:
    """Blocks of signatures (kind ``block``) and each task's document counts of terms (kind ``term``), written once."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[int, list] = defaultdict(list)
        df: Counter = Counter()

        def block(width: int):
            own = held.pop(width)
            ids, digests, n, most, keys = zip(*own, strict=True)
            cols = ["block"], [None], [None], [width], [list(ids)], [b"".join(digests)], [list(n)], [list(most)], [slices(width, list(keys)).tobytes()]
            return frame(cols)

        def counts():
            out = [*df.items()]
            df.clear()
            for i in range(0, len(out), 1 << 16):
                own = out[i : i + (1 << 16)]
                empty = [None] * len(own)
                yield frame((["term"] * len(own), [t.decode("utf-8", "replace") for t, _ in own], [c for _, c in own], *[empty] * 6))

        kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
        names = [c.split()[0] for c in INDEX.split(", ")]

        def frame(cols):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                for doc, text, sha in zip(part.column(0).to_pylist(), texts(part.column(1)), part.column(2).to_pylist(), strict=True):
                    own = terms(text)
                    if not own:
                        continue
                    tf = Counter(own)
                    df.update(tf.keys())
                    h, times = hashes(tf), np.fromiter(tf.values(), np.int64, len(tf))
                    most = int(times.max())
                    keys = np.concatenate([level_keys(h[times >= 1 << level], level) for level in range(most.bit_length())])
                    width = min(WIDEST, max(NARROWEST, 1 << (BITS_PER_KEY * len(keys) - 1).bit_length()))
                    held[width].append((doc, sha, len(own), most, keys))
                    if len(held[width]) >= min(DOCUMENTS, max(8, BLOCK // width)):
                        yield block(width)
                if len(df) > COUNTED:
                    yield from counts()
        for width in list(held):
            yield block(width)
        yield from counts()

    path = f"{shared_folder(docs.sparkSession)}/lexical-{uuid.uuid4()}"
    docs.select("doc_id", "text", digest(F.col("text")).alias("digest")).mapInArrow(run, INDEX).write.partitionBy("kind").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


class Items:
    """Items of one block, as tasks need them: the weights of their terms in a matrix, and the corpus's figures."""

    def __init__(self, numbers: list[int], own: list[list[bytes]], weight: dict[bytes, int], documents: int, length: int):
        self.numbers, self.documents, self.length = np.array(numbers), documents, length
        self.weights = [{t: weight[t] for t in x if weight.get(t)} for x in own]
        every = sorted({t for x in self.weights for t in x})
        place = {t: i for i, t in enumerate(every)}
        self.hashes = hashes(every)
        self.matrix = np.zeros((len(own), len(every)), np.float32)
        for i, x in enumerate(self.weights):
            for t, w in x.items():
                self.matrix[i, place[t]] = w
        #: Sums of n positive float32 products differ from the exact sum by less than n + 2 roundings.
        self.slack = 1 + 2e-7 * (10 + max(map(len, self.weights), default=0))

    def m(self, n):
        return 50 + 50 * n * self.documents // self.length

    def bounds(self, block: dict) -> Iterator[tuple[int, np.ndarray]]:
        """(first document, upper bounds of the items' scores) for parts of a block."""
        width, n, most = block["width"], np.array(block["n"], np.int64), np.array(block["most"], np.int64)
        kept = np.frombuffer(block["slices"], np.uint8).reshape(width, -1)
        m = self.m(n)
        for i in range(0, len(n), AT_ONCE):
            part = slice(i, i + AT_ONCE)
            view = kept[:, i // 8 : (i + AT_ONCE) // 8]
            present, held, before = np.arange(len(self.hashes)), None, 0.0
            most_ = most[part]
            for level in range(int(most_.max()).bit_length()):
                maybe = np.bitwise_and.reduce(view[bits(level_keys(self.hashes[present], level), width)], axis=1)
                if held is not None:
                    maybe &= held
                some = maybe.any(axis=1)
                present, held = present[some], maybe[some]
                if not len(present):
                    break
                times = np.minimum((2 << level) - 1, most_)
                gain = times * 1e9 / (1000 * times + 20 * m[part])
                now = np.unpackbits(held, axis=1, count=len(most_)).astype(np.float32)
                now *= np.maximum(0, gain - before).astype(np.float32)
                if level == 0:
                    first, total = present, now
                else:
                    total[np.searchsorted(first, present)] += now
                before = gain
            if held is not None and (level or len(present)):
                yield i, self.matrix[:, first] @ total * np.float32(self.slack)

    def score(self, text: str, wanted: list[int]) -> list[int]:
        """Exact scores of the wanted items (by place)."""
        own = terms(text)
        tf, m = Counter(own), self.m(len(own))
        found = []
        for i in wanted:
            total = 0
            for t, w in self.weights[i].items():
                if c := tf.get(t):
                    total += w * (1_000_000_000 * c // (1000 * c + 20 * m))
            found.append(total)
        return found


FOUND = "place int, doc_id long, digest binary, bound double"


def _rows(out: list[tuple[np.ndarray, np.ndarray, list, list]]) -> pd.DataFrame:
    place, bound, ids, digests = ([x for o in out for x in o[k]] for k in range(4))
    return pd.DataFrame({"place": np.array(place, np.int32), "doc_id": pd.array(ids, "Int64"), "digest": pd.Series(digests, dtype=object), "bound": np.array(bound, float)})


def _blocks(frames: Iterator[pd.DataFrame], items: Items):
    for f in frames:
        for block in f.to_dict("records"):
            yield from ((block, i, upper) for i, upper in items.bounds(block))


def _named(block: dict, at: np.ndarray) -> tuple[list, list]:
    ids, digests = block["doc_ids"], block["digests"]
    return [None if pd.isna(ids[j]) else int(ids[j]) for j in at], [digests[16 * j : 16 * j + 16] for j in at]


def highest(blocks: DataFrame, shared, k: int) -> DataFrame:
    """The documents with the k highest bounds of each item in each task."""

    def run(frames):
        items, best = shared.value, {}
        for block, i, upper in _blocks(frames, items):
            for place in np.nonzero((upper > 0).any(axis=1))[0]:
                own = upper[place]
                least = best[place][0][-1] if place in best and len(best[place][0]) >= k else 0
                at = np.nonzero(own > least)[0]
                if len(at) > k:
                    at = at[np.argpartition(-own[at], k)[:k]]
                if len(at):
                    ids, digests = _named(block, i + at)
                    was = best.get(place, ([], [], []))
                    both = sorted(zip([*was[0], *own[at].tolist()], [*was[1], *ids], [*was[2], *digests], strict=True), key=lambda x: -x[0])[:k]
                    best[place] = tuple(map(list, zip(*both, strict=True)))
        if best:
            yield _rows([([p] * len(b[0]), b[0], b[1], b[2]) for p, b in best.items()])

    return blocks.mapInPandas(run, FOUND)


def reaching(blocks: DataFrame, shared, least: dict[int, int]) -> DataFrame:
    """All documents whose bound reaches the least score of an item."""

    def run(frames):
        items = shared.value
        lowest = np.array([least.get(i, 1) for i in range(len(items.numbers))], float)
        out, n = [], 0
        for block, i, upper in _blocks(frames, items):
            place, at = np.nonzero(upper >= lowest[:, None])
            if len(at):
                out.append((place.tolist(), upper[place, at].tolist(), *_named(block, i + at)))
                n += len(at)
            if n > 1 << 16:
                yield _rows(out)
                out, n = [], 0
        if out:
            yield _rows(out)

    return blocks.mapInPandas(run, FOUND)


def scored(docs: DataFrame, found: DataFrame, shared) -> DataFrame:
    """place, digest, score of the texts found, one reading of a text for all its items."""
    # A block's places at most are collected for a text.
    own = materialise(found.groupBy("digest").agg(F.min("doc_id").alias("one"), F.collect_set("place").alias("places")))
    few = own.count() <= FEW
    texts_ = docs.select(F.col("doc_id").alias("own_id"), "text", digest(F.col("text")).alias("own_digest"))
    asked = texts_.join(F.broadcast(own) if few else own.hint("merge"), (F.col("own_digest") == F.col("digest")) & F.col("own_id").eqNullSafe(F.col("one")))

    def run(frames: Iterator[pd.DataFrame]):
        items = shared.value
        for f in frames:
            scores = [items.score(t, list(p)) for t, p in zip(f["text"], f["places"], strict=True)]
            yield pd.DataFrame({"digest": f["digest"], "place": f["places"].map(list), "score": scores}).explode(["place", "score"]).astype({"place": "int32", "score": "int64"})

    return asked.select("text", "digest", "places").mapInPandas(run, "digest binary, place int, score long").groupBy("digest", "place").agg(F.max("score").alias("score"))


def search(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item. ``queries``: item_id, text."""
    spark = docs.sparkSession
    every = index(docs)
    blocks = every.filter("kind = 'block'").drop("kind", "term", "df")
    counts = every.filter("kind = 'term'").select("term", "df")
    figures = blocks.agg(F.sum(F.size("n")), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = F.array_distinct(F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1)))
    items = queries.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().select("item_id", own.alias("terms")).filter(F.size("terms") > 0)
    items = items.select("*", F.monotonically_increasing_id().alias("item"))
    items = materialise(items)
    parts = -(-(items.agg(F.sum(F.size("terms"))).first()[0] or 0) // PAIRS) if figures[0] else 0
    items = items.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(max(1, parts))))
    out = [spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    for part in range(parts):
        mine = items.filter(F.col("part") == part)
        wanted = mine.select(F.explode("terms").alias("term")).distinct()
        df = {r.term: r.df for r in counts.join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # about PAIRS at most
        rows = mine.orderBy("item").collect()
        weight = {t.encode(): math.floor(1000 * math.log((2 * figures[0] + 2) / (2 * n + 1))) for t, n in df.items()}
        block = Items([r.item for r in rows], [[t.encode() for t in r.terms] for r in rows], weight, figures[0], figures[1])
        shared = spark.sparkContext.broadcast(block)
        ids = F.broadcast(spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "place int, item_id long"))

        def best(found: DataFrame, column: str, most: int) -> DataFrame:
            rank = F.row_number().over(W.partitionBy("place").orderBy(F.desc(column), F.asc_nulls_last("doc_id"))).alias("rank")
            return found.select("*", rank).filter(F.col("rank") <= most)

        probes = materialise(best(highest(blocks, shared, PROBES * k), "bound", PROBES * k).select("place", "doc_id", "digest"))
        first = best(probes.join(scored(docs, probes, shared), ["place", "digest"]), "score", k).groupBy("place").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        least = {r.place: max(1, r.least) for r in first.filter(F.col("n") == k).collect()}  # a row for each item of the block
        copy = F.row_number().over(W.partitionBy("place", "digest").orderBy(F.asc_nulls_last("doc_id"))).alias("copy")
        maybe = reaching(blocks, shared, least).select("place", "doc_id", "digest", copy).filter(F.col("copy") <= k).drop("copy")
        maybe = materialise(maybe)
        final = best(maybe.join(scored(docs, maybe, shared).filter("score > 0"), ["place", "digest"]), "score", k)
        out.append(final.join(ids, "place").select("item_id", "rank", "doc_id", "score"))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found
