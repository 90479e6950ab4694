"""Following sessions as their files grow: offsets and batch numbers of each session, without loss or repeat.

A stream of entries (session, seq, ...) is written batch by batch. Entries that a session's offset has
passed are left out, so files may be read again from their start; the others get the number of their
session's batch. First the entries of a batch are written, then the offsets, each to the batch's own
folder; a batch that failed in between is written again in place of what it left. The last batch's
offsets hold all sessions, so only they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weir.sources.sinks import appended, read_batches

OFFSETS = "session long, offset long, push long"


def offsets(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """session, offset (of the next entry), push (number of its last batch), as of the last batch that is whole."""
    rows = read_batches(spark, f"{path}/offsets", OFFSETS, before)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == (-1 if last is None else last)).drop("batch")


def follow(entries: DataFrame, path: str, checkpoint: str, after_write=None) -> StreamingQuery:
    """Starts the stream over what is there (``availableNow``). ``after_write(batch)`` is called between entries and offsets, for tests."""
    spark = entries.sparkSession

    def push(rows: DataFrame, batch: int) -> None:
        known = offsets(spark, path, before=batch)
        fresh = rows.join(known, "session", "left").filter(F.col("seq") >= F.coalesce("offset", F.lit(0)))
        fresh = fresh.withColumn("push", F.coalesce("push", F.lit(0)) + 1).drop("offset").dropDuplicates(["session", "seq"])
        appended(f"{path}/entries")(fresh, batch)
        if after_write:
            after_write(batch)
        # Read again, so that offsets are those of the entries written.
        own = spark.read.schema(fresh.schema).parquet(f"{path}/entries/batch={batch}").groupBy("session").agg((F.max("seq") + 1).cast("long").alias("offset"), F.max("push").cast("long").alias("push"))
        appended(f"{path}/offsets")(own.unionByName(known.join(own.select("session"), "session", "left_anti")), batch)

    return entries.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def followed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All entries of the batches that are whole, with push, the number of their session's batch."""
    done = read_batches(spark, f"{path}/offsets", OFFSETS).agg(F.max("batch")).first()[0]
    return read_batches(spark, f"{path}/entries", schema + ", push long", (-1 if done is None else done) + 1).drop("batch")
