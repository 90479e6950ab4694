"""Filters, rollups and merges for reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def reviews(marks: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The latest mark of each anchor with its latest resolution; open if there is none or the mark came after it."""
    at = F.struct("sec", "id")
    m = marks.groupBy("anchor").agg(F.max_by("id", at).alias("mark"), F.max("sec").alias("raised"))
    r = resolutions.groupBy("anchor").agg(F.max("sec").alias("resolved"))
    return m.join(r, "anchor", "left").withColumn("open", F.col("resolved").isNull() | (F.col("raised") > F.col("resolved")))


def merged(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first source, then those of each later one whose key no earlier one has."""

    def add(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b.join(a.select(key), key, "left_anti").select(*a.columns))

    return reduce(add, sources)


def visible_to(rows: DataFrame, source: str, me: str) -> DataFrame:
    """All but what a personal source sent to others."""
    return rows.filter((F.col("topic") != source) | (F.col("author") == me))


def wanted(items: DataFrame, status: str | None = None, priority: int | None = None, owner: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Items that meet all filters that are given; several states are separated by commas."""
    tests: list[Column] = [F.lit(True)]
    if status:
        tests.append(F.col("status").isin(*(s.strip() for s in status.split(","))))
    for name, value in (("priority", priority), ("owner", owner)):
        if value is not None:
            tests.append(F.col(name) == value)
    if since:
        tests.append(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until:
        tests.append(F.col("created_at") < F.lit(until).cast("timestamp"))
    return items.filter(reduce(lambda a, b: a & b, tests))


def strongest(rows: DataFrame, order: list[str]) -> DataFrame:
    """Of each author the reason that comes first in ``order``, and how often it was given; others count least."""
    rank = F.coalesce(F.array_position(F.lit(order), F.col("topic")), F.lit(0))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    g = rows.groupBy("author", "topic").agg(F.count("*").alias("n")).withColumn("rank", rank)
    return g.groupBy("author").agg(F.min_by(F.struct("topic", "n"), F.struct("rank", "topic")).alias("s")).select("author", "s.topic", "s.n")


def best_first(rows: DataFrame, key: list[str], score: str, tie: str) -> DataFrame:
    """Of rows with equal keys the one with the best score."""
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(score), tie))).filter("_rank = 1").drop("_rank")


def newest_of(streams: list[DataFrame], k: int) -> DataFrame:
    """The newest ``k`` rows of several stores together: each gives its own newest, so only those meet."""
    tops = [s.orderBy(F.desc("sec"), F.desc("id")).limit(k) for s in streams]
    return reduce(DataFrame.unionByName, tops).orderBy(F.desc("sec"), F.desc("id")).limit(k)


def masked(entries: DataFrame, ranges: DataFrame) -> DataFrame:
    """Entries of each author within a range [start, end), each counted once, and all others; an open range lasts for good."""
    r = ranges.select(F.col("author").alias("ra"), F.col("start").alias("lo"), F.col("end").alias("hi"))
    inside = (F.col("author") == F.col("ra")) & (F.col("sec") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("sec") < F.col("hi")))
    hidden = entries.join(r, inside, "left_semi").groupBy("author").agg(F.count("*").alias("masked"))
    total = entries.groupBy("author").agg(F.count("*").alias("n"))
    return total.join(hidden, "author", "left").select("author", "n", F.coalesce("masked", F.lit(0)).alias("masked"))


def completed_weeks(rows: DataFrame, as_of: int) -> DataFrame:
    """Rows of each ISO week that has ended by ``as_of``."""
    w = rows.groupBy(F.date_trunc("week", "ts").alias("w")).agg(F.count("*").alias("n")).filter(F.unix_timestamp("w") + 7 * 86400 <= as_of)
    year, week = F.extract(F.lit("YEAROFWEEK"), F.col("w")), F.weekofyear("w")
    return w.select(F.concat(year.cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0")).alias("week"), "n")


def completed_months(rows: DataFrame, as_of: int) -> DataFrame:
    """Rows of each calendar month that has ended by ``as_of``."""
    m = rows.groupBy(F.date_trunc("month", "ts").alias("m")).agg(F.count("*").alias("n"))
    return m.filter(F.unix_timestamp(F.add_months("m", 1).cast("timestamp")) <= as_of).select(F.date_format("m", "yyyy-MM").alias("month"), "n")


def relevance(rows: DataFrame, files: list[str], topics: list[str], weight: float) -> DataFrame:
    """1.0 for a row on one of the files, 0.6 for one on one of the topics, times the weight; others are left out."""
    score = F.when(F.col("file").isin(files), 1.0).when(F.col("topic").isin(topics), 0.6)
    return rows.withColumn("score", F.round(score * weight, 6)).filter("score is not null").select("id", "score")
