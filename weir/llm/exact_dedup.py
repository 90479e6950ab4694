"""Exact deduplication by two-pass Bloom filtering.

Pass one counts every text hash in a counting Bloom filter with two-bit counters (0, 1, many). Pass
two asks the filter: a hash with a counter below "many" occurs once, and its row passes straight
through; only possibly repeated rows are shuffled, and these are compared by their SHA-256. A filter
has at most ``MAX_COUNTERS`` counters. More rows than ``ROWS`` are cut into ranges of hashes, each with a
filter of its own, which are asked one after the other; for that the short rows (ids and hashes, no
texts) are dealt by range once.

Defined cases: a null text counts as empty, so all null and empty texts are equal. Rows with equal
text and equal doc_id are copies too, of which one stays. A null doc_id counts as smaller than any
other. Empty tables give empty results. Extra columns don't matter; the results use own names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import HOT_GROUPS, join_groups, materialise, mix, shared_folder, whole_row

HASHES = 3
COUNTERS_PER_ROW = 16
#: The filter that pass two broadcasts has a bit for each counter: 64 MB at most.
MAX_COUNTERS = 1 << 29
#: Rows of one range: so many that the filter keeps its counters for each row.
ROWS = MAX_COUNTERS // COUNTERS_PER_ROW
SLICE = 1 << 20


def text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def short_hash(sha: Column) -> Column:
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")


def _positions(h: np.ndarray, counters: int) -> list[np.ndarray]:
    return [(mix(h.astype(np.uint64) + np.uint64(7919 * i)) % np.uint64(counters)).astype(np.int64) for i in range(HASHES)]


def repeated_filter(hashes: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """Pass one over a long column ``h``: a bit array of the counters that reached "many".

    Each task counts its own rows and emits, for each slice of the filter, the counters that are one
    or many; a slice is merged in one task, from at most two positions a row.
    """
    counters = int(min(MAX_COUNTERS, max(SLICE, 1 << int(np.ceil(np.log2(max(1, rows) * COUNTERS_PER_ROW))))))

    def count(batches):
        held = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        h = np.concatenate(held) if held else np.empty(0, np.int64)
        at, n = np.unique(np.concatenate(_positions(h, counters)), return_counts=True)
        cuts = np.searchsorted(at, np.arange(0, counters + SLICE, SLICE))
        for k in range(len(cuts) - 1):
            if cuts[k] < cuts[k + 1]:
                part = (at[cuts[k] : cuts[k + 1]] - k * SLICE).astype(np.uint32) * 2 + (n[cuts[k] : cuts[k + 1]] > 1)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zstandard.compress(np.diff(part, prepend=np.uint32(0)).astype(np.uint32).tobytes(), 1)], pa.binary())], ["slice", "blob"])

    def merge(batches):
        once: dict[int, np.ndarray] = {}
        many: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k not in once:
                    once[k], many[k] = np.zeros(SLICE, bool), np.zeros(SLICE, bool)
                part = np.cumsum(np.frombuffer(zstandard.decompress(blob), np.uint32), dtype=np.uint32)
                at = part >> 1
                many[k][at] |= once[k][at] | (part & 1).astype(bool)
                once[k][at] = True
        for k, bits in many.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zstandard.compress(np.packbits(bits).tobytes())], pa.binary())], ["slice", "bits"])

    parts = hashes.select("h").mapInArrow(count, "slice int, blob binary").repartition(max(1, counters // SLICE), "slice").mapInArrow(merge, "slice int, bits binary")
    bits = np.zeros(counters // 8, np.uint8)
    for r in parts.collect():  # MAX_COUNTERS bits at most
        bits[r.slice * SLICE // 8 : (r.slice + 1) * SLICE // 8] = np.frombuffer(zstandard.decompress(r.bits), np.uint8)
    return bits, counters


def contains(h: np.ndarray, bits: np.ndarray, counters: int) -> np.ndarray:
    found = np.ones(len(h), bool)
    for at in _positions(h, counters):
        found &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return found


def maybe_repeated(h: Column, bits: Broadcast, counters: int) -> Column:
    """Pass two: false only for hashes that occur once."""

    @F.pandas_udf("boolean")
    def ask(x: pd.Series) -> pd.Series:
        return pd.Series(contains(x.to_numpy(np.int64), bits.value, counters))

    return ask(h)


def marked(rows: DataFrame, total: int) -> DataFrame:
    """``rows``, written and with a long column ``h``, with ``maybe``: false only where the hash occurs once."""
    ranges = -(-total // ROWS)
    if ranges > 1:
        spread = rows.withColumn("range", F.pmod(F.xxhash64("h"), F.lit(ranges)).cast("int"))
        path = f"{shared_folder(rows.sparkSession)}/ranges-{uuid.uuid4()}"
        spread.repartition(F.col("range"), F.pmod(F.monotonically_increasing_id(), F.lit(16))).write.partitionBy("range").parquet(path)
        spread = rows.sparkSession.read.schema(spread.schema).parquet(path)
        parts = [spread.filter(F.col("range") == k).drop("range") for k in range(ranges)]
    else:
        parts = [rows]
    out = []
    for part in parts:
        bits, counters = repeated_filter(part, part.count() if ranges > 1 else total)
        shared = rows.sparkSession.sparkContext.broadcast(bits)
        out.append(materialise(part.withColumn("maybe", maybe_repeated(F.col("h"), shared, counters))))
        shared.unpersist()  # all that needs it is written
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("text_sha256"))
    rows = materialise(rows.select("*", short_hash(F.col("text_sha256")).alias("h"), F.monotonically_increasing_id().alias("row")))
    total = rows.count()
    rows = marked(rows, total)
    single = rows.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = rows.filter("maybe").select("doc_id", "text_sha256", "row")
    groups = maybe.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    groups = materialise(groups)
    found = join_groups(maybe, groups, "text_sha256", "group_size", total)
    return single.unionByName(found.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each text, the one with the largest doc_id; the columns stay.

    The groups are made from ids and hashes alone; then a filter of the texts that are repeated lets
    all other rows pass straight through. The rows of hot texts are decided where they are.
    """
    sha = text_hash(F.col("text"))
    rows = materialise(docs.select("doc_id", sha.alias("sha")).withColumn("h", short_hash(F.col("sha"))))
    total = rows.count()
    groups = marked(rows, total).filter("maybe").groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("size")).filter("size > 1")
    groups = materialise(groups)
    ids = groups.select(short_hash(F.col("sha")).alias("h"))
    bits, counters = repeated_filter(ids.unionAll(ids), 2 * groups.count())  # each twice, so that its counters are many
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    told = docs.select(whole_row(docs), sha.alias("sha")).withColumn("maybe", maybe_repeated(short_hash(F.col("sha")), shared, counters))
    maybe = told.filter("maybe").select("r", "sha")
    # As in join_groups, but rows that the filter marked in error stay.
    hot = F.col("size") >= max(2, -(-total // HOT_GROUPS))
    often = F.broadcast(groups.filter(hot))
    last = F.col("r.doc_id").eqNullSafe(F.col("keep_id"))
    rest = maybe.join(often.select("sha"), "sha", "left_anti").join(groups.filter(~hot).hint("merge"), "sha", "left")
    kept = maybe.join(often, "sha").filter(last).select("sha", "r").unionByName(rest.filter(F.col("size").isNotNull() & last).select("sha", "r"))
    kept = kept.groupBy("sha").agg(F.first("r").alias("r"))  # of rows that are equal in both any one; a task sends one of each on
    return told.filter(~F.col("maybe")).select("r.*").unionByName(rest.filter("size is null").select("r.*")).unionByName(kept.select("r.*"))
