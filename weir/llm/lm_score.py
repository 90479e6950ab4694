"""Stupid-backoff scores of documents under a bigram model of the whole corpus.

Every word is scored after the word before it (the first after a start mark): c(v w) / c(v) if the
bigram occurs at least ``min_count`` times, else ``alpha`` c(w) / N; c(v) counts v where a word
follows. A document's score is the sum of the logarithms. Words are the runs between ASCII white space
with A-Z lower-cased.

The count tables are partitioned by hash and the documents' n-grams come to them. Since a row for each
of them would move several times the input, the n-grams of many documents are moved as sorted, packed
arrays, one for each partition: a task that holds a partition counts its n-grams, looks each up and
sends on the sums by document. Bigrams go by their first word, so that its count is known there too;
the bigrams of frequent first words are dealt by both words, with the first word's count taken from a
table of words that make up at least 1 / ``FREQUENT`` of all, at most ``FREQUENT`` of them. Bigrams that
make up at least 1 / ``OFTEN`` of all, at most 2 * ``OFTEN`` of them, are not moved at all: their counts
are broadcast and their scores summed where the documents are, so no partition holds more of one
bigram than that. Rare words that a bigram backs off to meet the table of word counts in a second round.

Defined cases: null and empty texts have no words, a sum of 0 and no mean. Repeated rows count as
often as they occur and get equal scores; null ids stay. Very long texts are read whole. Empty tables
give no rows; extra columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import materialise, mix, texts, written

FREQUENT, OFTEN = 1 << 17, 1 << 16
#: Words that a task packs at once, and n-grams that a partition holds.
CHUNK, PART = 1_000_000, 3_000_000
#: Copies of one row that are made at once.
COPIES = 4096
RARE = np.uint64(1 << 63)
START = np.uint64((1 << 63) - 1)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def hashes(own: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))


def _put(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers, packed byte plane by byte plane; the first is stored as differences."""
    first, *rest = (np.ascontiguousarray(a, np.uint64) for a in arrays)
    planes = np.stack([np.diff(first, prepend=np.uint64(0)), *rest]).view(np.uint8).reshape(len(arrays), -1, 8).transpose(0, 2, 1)
    return zstandard.compress(len(arrays).to_bytes(1, "little") + planes.tobytes(), 1)


def _get(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    out = np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], 8, -1).transpose(0, 2, 1)).view(np.uint64)[:, :, 0]
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def _times(x: np.ndarray) -> np.ndarray:
    """How often each element occurs in ``x``."""
    by = np.argsort(x)
    y = x[by]
    edge = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1], [True]]))
    out = np.empty(len(x), np.int64)
    out[by] = np.repeat(np.diff(edge), np.diff(edge))
    return out


def pairs(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of the bigrams that end in each word; ``first`` marks a document's first."""
    before = np.concatenate([[START], h[:-1]])
    before[first] = START
    return mix(before * np.uint64(0x9E3779B97F4A7C15) ^ mix(h))


def starts_of(held: list[np.ndarray]) -> np.ndarray:
    first = np.zeros(sum(map(len, held)), bool)
    first[np.cumsum([0] + [len(x) for x in held[:-1]])] = True
    return first


def _chunks(batches):
    """Hashes of the words of so many documents that they make up a chunk."""
    held, size = [], 0
    for b in batches:
        for t in texts(b.column(0)):
            h = hashes(words(t))
            if len(h):
                held.append(h)
                size += len(h)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if size:
        yield held


def word_counts(docs: DataFrame) -> DataFrame:
    """h, n (occurrences), followed (occurrences before another word), and with followed null the bigrams that are often in some chunk."""

    def run(batches):
        for held in _chunks(batches):
            words_, first = np.concatenate(held), starts_of(held)
            h, n = np.unique(words_, return_counts=True)
            ends, m = np.unique(np.array([x[-1] for x in held], np.uint64), return_counts=True)
            followed = n.copy()
            followed[np.searchsorted(h, ends)] -= m
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64()), pa.array(followed, pa.int64())], ["h", "n", "followed"])
            h, n = np.unique(pairs(words_, first), return_counts=True)
            h, n = h[n * 2 * OFTEN >= len(words_)], n[n * 2 * OFTEN >= len(words_)]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64()), pa.nulls(len(h), pa.int64())], ["h", "n", "followed"])

    found = docs.select("text").mapInArrow(run, "h long, n long, followed long")
    return found.groupBy("h", F.col("followed").isNull().alias("pair")).agg(F.sum("n").alias("n"), F.sum("followed").alias("followed"))


def often(docs: DataFrame, candidates: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the bigrams that make up 1 / ``OFTEN`` of all.

    Such a bigram makes up half that share in chunks that hold half of its occurrences at least; so
    the candidates' counts there leave 2 * ``OFTEN`` of them, whose whole counts come from a second pass.
    """
    rows = candidates.filter(F.col("n") * (2 * OFTEN) >= total).select("h").toPandas()["h"]
    asked = np.sort(rows.to_numpy(np.int64).view(np.uint64))
    if not len(asked):
        return asked, np.zeros(0, np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        counts = np.zeros(len(shared.value), np.int64)
        for held in _chunks(batches):
            h = pairs(np.concatenate(held), starts_of(held))
            at = np.minimum(np.searchsorted(shared.value, h), len(counts) - 1)
            counts += np.bincount(at[shared.value[at] == h], minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["at", "n"])

    out = np.zeros(len(asked), np.int64)
    for r in docs.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r.at] = r.n
    shared.unpersist()
    return asked, out


def score(docs: DataFrame, min_count: int = 2, alpha: float = 0.4) -> DataFrame:
    """doc_id, n_words, n_backoff, log_score, mean_log_score."""
    spark = docs.sparkSession
    found = written(word_counts(docs))
    counts = found.filter("not pair").drop("pair")
    total = counts.agg(F.sum("n")).first()[0] or 0
    starts = total - (counts.agg(F.sum("followed")).first()[0] or 0)  # documents with a word
    rows = counts.filter(F.col("n") * FREQUENT >= total).select("h", "n", "followed").collect()
    order = np.argsort(np.array([r.h for r in rows], np.int64).view(np.uint64), kind="stable")
    table = spark.sparkContext.broadcast((*(np.array([r[i] for r in rows], np.int64)[order] for i in range(3)), *often(docs, found.filter("pair"), total)))
    parts = max(12, -(-total // PART))
    second = max(12, -(-total // (4 * PART)))  # partitions of the second round, which has far less
    log_back = math.log(alpha) - math.log(max(1, total))

    def pack(batches):
        frequent, (_, n_of, followed_of, pair, c2_of) = table.value[0].view(np.uint64), table.value
        keys, base, held, at, sums = [], [], [], [], []

        def flush():
            h, doc, first = np.concatenate(held), np.concatenate(at), starts_of(held)
            k = np.minimum(np.searchsorted(frequent, h), max(0, len(frequent) - 1))
            known = frequent[k] == h if len(frequent) else np.zeros(len(h), bool)
            code = np.where(known, k.astype(np.uint64), (h >> np.uint64(1)) | RARE)
            before = np.concatenate([[START], code[:-1]])
            before[first] = START
            here = np.zeros(len(h), bool)
            if len(pair):
                p = pairs(h, first)
                k = np.minimum(np.searchsorted(pair, p), len(pair) - 1)
                # The words of such a bigram are frequent themselves.
                here = (pair[k] == p) & (code < START) & (before <= START)
            if here.any():
                c2, v, w = c2_of[k[here]], before[here], code[here].astype(np.int64)
                known = followed_of[np.minimum(v, np.uint64(len(followed_of) - 1)).astype(np.int64)]
                value = np.where(c2 >= min_count, np.log(c2) - np.log(np.where(v == START, starts, known)), log_back + np.log(n_of[w]))
                sums[:] = np.bincount(doc[here], value, len(keys)), np.bincount(doc[here], c2 < min_count, len(keys))
            else:
                sums[:] = np.zeros(len(keys)), np.zeros(len(keys))
            code, before, doc = code[~here], before[~here], doc[~here]
            to = mix(before * np.uint64(0x9E3779B97F4A7C15) + np.where(before < RARE, code + np.uint64(1), np.uint64(0))) % np.uint64(parts)
            # By partition and, roughly, by both words: equal n-grams lie together, which packs best.
            rough = lambda x: np.where(x < RARE, np.minimum(x, np.uint64((1 << 23) - 1)), (x >> np.uint64(40)) & np.uint64((1 << 24) - 1))
            by = np.argsort((to << np.uint64(48)) | (rough(before) << np.uint64(24)) | rough(code), kind="stable") if parts < 1 << 16 else np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[by], np.arange(parts + 1).astype(np.uint64))
            own = np.array(keys, np.uint64)
            for p in range(parts):
                if cuts[p] < cuts[p + 1]:
                    x = by[cuts[p] : cuts[p + 1]]
                    used, local = np.unique(doc[x], return_inverse=True)
                    yield p, _put(before[x], code[x], local), _put(own[used]), None

        def rows_of(found):
            found = list(found)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["part", "grams", "docs", "base"])

        def base_row():
            ids = np.array([0 if d is None else d for d, _ in base], np.int64)
            back = sums[1].astype(np.uint64) if sums else np.zeros(len(keys), np.uint64)
            own = sums[0] if sums else np.zeros(len(keys))
            return [(int(keys[0]) % parts, None, _put(np.array(keys, np.uint64)), _put(ids.view(np.uint64), np.array([n for _, n in base], np.uint64), np.array([d is None for d, _ in base], np.uint64), own.view(np.uint64), back))]

        size = 0
        for b in batches:
            for doc_id, t in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                own = words(t)
                keys.append(xxhash.xxh3_64_intdigest(f"{doc_id} {t}".encode("utf-8", "surrogatepass")))
                base.append((doc_id, len(own)))
                if own:
                    held.append(hashes(own))
                    at.append(np.full(len(own), len(keys) - 1, np.uint32))
                    size += len(own)
                if size >= CHUNK or len(base) >= 100_000:
                    yield rows_of([*(flush() if size else ()), *base_row()])
                    keys, base, held, at, sums, size = [], [], [], [], [], 0
        if base:
            yield rows_of([*(flush() if size else ()), *base_row()])

    def look_up(batches):
        _, n_of, followed_of, _, _ = table.value
        blobs: dict[int, list] = {}
        for b in batches:
            for p, grams, docs_, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if grams is None:
                    yield pa.RecordBatch.from_arrays([pa.array([p % second], pa.int32()), pa.array([None], pa.binary()), pa.array([docs_], pa.binary()), pa.array([base], pa.binary())], ["part", "grams", "docs", "sums"])
                else:
                    blobs.setdefault(p, []).append((grams, docs_))
        for p in list(blobs):
            own = blobs.pop(p)
            before, code, doc, keys, offset = [], [], [], [], 0
            for grams, docs_ in own:
                x, y, z = _get(grams)
                k = _get(docs_)[0]
                before.append(x), code.append(y), doc.append((z + np.uint64(offset)).astype(np.uint32)), keys.append(k)
                offset += len(k)
            own = None
            before, code, doc, keys = map(np.concatenate, (before, code, doc, keys))
            c2 = _times(mix(before * np.uint64(0x9E3779B97F4A7C15) ^ mix(code)))
            followed = _times(before)
            known = before < START
            followed[known] = followed_of[before[known].astype(np.int64)]
            followed[before == START] = starts
            del before
            hit = c2 >= min_count
            value = np.full(len(code), log_back)
            value[hit] = np.log(c2[hit]) - np.log(followed[hit])
            known = ~hit & (code < START)
            value[known] += np.log(n_of[code[known].astype(np.int64)])
            sums = np.bincount(doc.astype(np.int64), value, len(keys))
            back = np.bincount(doc.astype(np.int64), ~hit, len(keys))
            yield pa.RecordBatch.from_arrays([pa.array([p % second], pa.int32()), pa.array([None], pa.binary()), pa.array([_put(keys)], pa.binary()), pa.array([_put(sums.view(np.uint64), back.astype(np.uint64))], pa.binary())], ["part", "grams", "docs", "sums"])
            rare = ~hit & (code >= RARE)
            to = mix(code[rare]) % np.uint64(second)
            by = np.lexsort((code[rare], to))
            w, d, to = code[rare][by], doc[rare][by].astype(np.int64), to[by]
            cuts = np.searchsorted(to, np.arange(second + 1).astype(np.uint64))
            for q in range(second):
                if cuts[q] < cuts[q + 1]:
                    used, local = np.unique(d[cuts[q] : cuts[q + 1]], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([_put(w[cuts[q] : cuts[q + 1]], local.astype(np.uint64))], pa.binary()), pa.array([_put(keys[used])], pa.binary()), pa.array([None], pa.binary())], ["part", "grams", "docs", "sums"])

    def add_up(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rare = (right["h"].to_numpy(np.int64).view(np.uint64) >> np.uint64(1)) | RARE
        order = np.argsort(rare)
        rare, n = rare[order], right["n"].to_numpy(np.int64)[order]
        own, values, backs, base = [], [], [], []
        for grams, docs_, sums in zip(left["grams"], left["docs"], left["sums"], strict=True):
            keys = _get(docs_)[0]
            if grams is not None:
                w, d = _get(grams)
                got = [np.bincount(d.astype(np.int64), np.log(n[np.searchsorted(rare, w)]), len(keys)), np.zeros(len(keys), np.int64)]
            else:
                got = _get(sums)
                if len(got) == 5:
                    ids = pd.array(got[0].view(np.int64), "Int64")
                    ids[got[2].astype(bool)] = pd.NA
                    base.append(pd.DataFrame({"key": keys.view(np.int64), "doc_id": ids, "n_words": got[1].astype(np.int64), "copies": 1, "n_backoff": got[4].astype(np.int64), "log_score": got[3].view(np.float64)}))
                    continue
                got = [got[0].view(np.float64), got[1].astype(np.int64)]
            own.append(keys), values.append(got[0]), backs.append(got[1])
        cols = ["key", "doc_id", "n_words", "copies", "n_backoff", "log_score"]
        if own:  # one row for each document
            keys, inverse = np.unique(np.concatenate(own), return_inverse=True)
            base.append(pd.DataFrame({"key": keys.view(np.int64), "n_backoff": np.bincount(inverse, np.concatenate(backs)).astype(np.int64), "log_score": np.bincount(inverse, np.concatenate(values))}))
        frame = pd.concat(base) if base else pd.DataFrame(columns=cols)
        return frame.reindex(columns=cols).astype({c: "Int64" for c in cols[:-1]} | {"log_score": "float64"}).fillna({"log_score": 0.0})

    packed = docs.select("doc_id", "text").mapInArrow(pack, "part int, grams binary, docs binary, base binary").repartitionById(parts, F.col("part"))  # one part in each task
    looked = packed.mapInArrow(look_up, "part int, grams binary, docs binary, sums binary")
    own = counts.filter(F.col("n") * FREQUENT < total)

    @F.pandas_udf("int")
    def part_of(h: pd.Series) -> pd.Series:
        return pd.Series((mix((h.to_numpy(np.int64).view(np.uint64) >> np.uint64(1)) | RARE) % np.uint64(second)).astype(np.int32))

    own = own.select(part_of("h").alias("part"), "h", "n")
    partial = looked.groupBy("part").cogroup(own.groupBy("part")).applyInPandas(add_up, "key long, doc_id long, n_words long, copies long, n_backoff long, log_score double")
    summed = materialise(partial.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("copies").alias("copies"), F.coalesce(F.sum("n_backoff"), F.lit(0)).alias("back"), F.sum("log_score").alias("s")))
    # Copies of a row that has many are made in many tasks, ``COPIES`` at a time.
    many = summed.filter(F.col("copies") > COPIES).withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), F.lit(COPIES)))).repartition("key", "from")
    many = many.withColumn("_", F.explode(F.sequence("from", F.least("copies", F.col("from") + COPIES - 1)))).drop("from")
    each = summed.filter(F.col("copies") <= COPIES).withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).unionByName(many)
    log_score = F.col("s") / F.col("copies")
    return each.select("doc_id", "n_words", (F.col("back") / F.col("copies")).cast("long").alias("n_backoff"), log_score.alias("log_score"), F.when(F.col("n_words") > 0, log_score / F.col("n_words")).alias("mean_log_score"))
