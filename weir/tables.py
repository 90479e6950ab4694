"""Intermediate tables that are written once and survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share: the cluster's ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs inside one process (tests) a temporary folder is taken; on
    a cluster without one it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared folder and returns it without its lineage, partitions and their order kept."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with ``number``, from 1 in the given order over all rows: sorted by ranges, with the sizes of the ranges before added."""
    at = F.monotonically_increasing_id()
    placed = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))  # a row for each range
    before = sizes.select("_part", (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn("number", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
