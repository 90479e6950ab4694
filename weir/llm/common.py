"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.tables import materialise, shared_folder

__all__ = ["held_out", "join_groups", "materialise", "mix", "shared_folder", "table", "texts", "whole_row", "written"]

#: A group counts as hot from this share of all rows; so at most this many groups are hot.
HOT_GROUPS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: as ``materialise``, but packed by columns and in new partitions."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    """All columns in one struct, so that no name can clash with those that an operator adds; ``select("r.*")`` takes them out again."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns)).alias("r")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the documents that no model may learn from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """Inner join of many rows to one row per group, where one group may hold a third of all rows.

    Groups of at least ``total / HOT_GROUPS`` rows are at most ``HOT_GROUPS``; they are broadcast, so
    that their rows stay where they are. All others are joined by a shuffle, in which no key has
    more than a thousandth of the rows.
    """
    keys = [key] if isinstance(key, str) else key
    least = max(2, -(-total // HOT_GROUPS))
    hot = F.broadcast(groups.filter(F.col(size) >= least))
    rest = groups.filter(F.col(size) < least)
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(rest.hint("merge"), keys)
    return rows.join(hot, keys).unionByName(cold)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit numbers (wraps around)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Texts of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]
