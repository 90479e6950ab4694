"""Contiguous shards of nearly equal bytes from global prefix sums.

Rows are put in order of doc_id by ranges; each partition's total of bytes and rows gives, summed up,
the place where the next partition starts; within a partition a running sum does the rest. A row
belongs to the shard in which its middle byte falls, so a shard differs from the target by at most
the largest row. Only ids and sizes are moved and never the texts.

Defined cases: a null text has no bytes and a crc32 of 0; every row has ``overhead`` bytes besides,
so empty texts are spread too. Null ids come first; rows with equal ids are ordered by size and crc32
and may be in two shards. An empty table gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from weir.llm.common import materialise


def prefix_sums(rows: DataFrame, size: str, order: list[str]) -> DataFrame:
    """Adds ``rank`` (rows before) and ``before`` (sum of ``size`` before) in the global order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    numbered = placed.withColumn("part", F.spark_partition_id())
    totals = numbered.groupBy("part").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    w = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    starts = totals.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("rank0"), F.coalesce(F.sum("bytes").over(w), F.lit(0)).alias("before0"))
    numbered = numbered.join(F.broadcast(starts), "part")  # keeps partitions and their order

    def run(batches):
        rank = before = 0
        for b in batches:
            size_ = b.column(b.schema.get_field_index(size)).to_numpy()
            if not len(size_):
                continue
            ends = np.cumsum(size_)
            r0, b0 = b.column(b.schema.get_field_index("rank0"))[0].as_py(), b.column(b.schema.get_field_index("before0"))[0].as_py()
            at = np.arange(len(size_)) + rank + r0
            keep = [i for i, n in enumerate(b.schema.names) if n not in ("part", "rank0", "before0")]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(at, pa.int64()), pa.array(ends - size_ + before + b0, pa.int64())], [*(b.schema.names[i] for i in keep), "rank", "before"])
            rank, before = rank + len(size_), before + int(ends[-1])

    schema = T.StructType([*placed.schema.fields, T.StructField("rank", T.LongType()), T.StructField("before", T.LongType())])
    return numbered.mapInArrow(run, schema)


def shards_by_bytes(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1), slot (gapless within the shard)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    summed = prefix_sums(rows, "size", ["doc_id", "size", "text_crc32"])
    total = summed.agg(F.max(F.col("before") + F.col("size"))).first()[0] or 1
    shard = F.expr(f"cast(((2 * before + size) * {shards}L) div {2 * total}L as int)")
    placed = summed.withColumn("shard", shard)
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))
