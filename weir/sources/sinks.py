"""Writes that a repeated or a failed load can't spoil: by date, in buckets, and batch by batch from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_date(rows: DataFrame, path: str, seconds: str = "created_at", unit: str = "yyyy-MM-dd", spread: int = 4) -> None:
    """Writes rows by the day (or other ``unit``) of a column of unix seconds; days that ``rows`` has are replaced, all others stay as they are.

    A day is dealt into ``spread`` parts, so a day with most of the rows is no single task's.
    """
    day = F.date_format(F.timestamp_seconds(F.col(seconds)), unit)
    parted = rows.withColumn("day", day).repartition(F.col("day"), F.pmod(F.xxhash64(*rows.columns), F.lit(spread)))
    parted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def write_bucketed(rows: DataFrame, name: str, path: str, key: str = "blob_id", buckets: int = 16, order: list[str] | None = None) -> DataFrame:
    """Writes rows as the table ``name`` at ``path``, in buckets of a key and sorted within them; returns the table.

    Tables in equal buckets of a key are joined on it without a shuffle. On a key and more columns too,
    where spark.sql.requireAllClusterKeysForCoPartition is false. Rows are dealt by bucket first, so that
    there is one file for each.
    """
    rows.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key, *(order or [])).option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)


def appended(path: str):
    """A writer for ``foreachBatch``: each batch has a folder of its own that a repetition of the batch replaces."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return put


def read_batches(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """All rows of a folder of batches with their ``batch``; with ``before`` only those of earlier batches."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    rows = spark.read.schema(schema + ", batch long").parquet(path) if there else spark.createDataFrame([], schema + ", batch long")
    return rows if before is None else rows.filter(F.col("batch") < before)
