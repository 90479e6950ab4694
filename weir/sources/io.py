"""Readers with fixed schemas, and the rules for repeated loads: first wins, last wins, skip what is unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """One JSON object a line (value); lines that don't parse are left out, fields that are missing are null."""
    rows = lines.select(F.from_json("value", schema + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return rows.filter("r is not null and r._broken is null").select("r.*").drop("_broken")


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parsed(spark.read.text(path).filter(F.trim("value") != ""), schema)


FACT = "headline string, summary string, rationale string, who string, source_type string, source_ref string, source_url string, source_title string, timestamp string, category string"


def write_facts(facts: DataFrame, path: str) -> None:
    """Facts as lines of JSON in a folder, which is the form that ``read_facts`` takes; fields that are null are left out."""
    facts.select(F.to_json(F.struct(*(c.split()[0] for c in FACT.split(", ")))).alias("value")).write.text(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts of files of lines: with a header {"_meta": ...}, in the older form of observations (content), or bare; headers and broken lines are left out."""
    rows = parsed(spark.read.text(path).filter(F.trim("value") != ""), FACT + ", content string, _meta string, schema_version string")
    own = rows.filter("_meta is null and schema_version is null").withColumn("headline", F.coalesce("headline", "content"))
    return own.filter("headline is not null").select(*(c.split()[0] for c in FACT.split(", ")))


def snapshots(rows: DataFrame, content: list[str]) -> DataFrame:
    """dir, number, hash: where the snapshot of each row is kept, by the day of its creation, its number and what it says."""
    said = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in content)), 256)
    return rows.select(F.date_format(F.timestamp_seconds("created_at"), "yyyy/MM/dd").alias("dir"), "number", F.substring(said, 1, 8).alias("hash"))


def new_snapshots(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Snapshots that aren't stored yet."""
    return rows.join(stored, ["dir", "number", "hash"], "left_anti")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key (last wins)."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*(F.col(c).desc_nulls_last() for c in order)))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` in place of ``old`` where the key is in both."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new.select(*old.columns))


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of ``new`` whose key isn't in ``old``; of equal keys the first in ``order``."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    first = new.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    return old.unionByName(first.join(old.select(*key), key, "left_anti").select(*old.columns))


def changed(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose (path, mtime) isn't known yet."""
    return files.join(seen.select("path", "mtime"), ["path", "mtime"], "left_anti")
