"""Dated entries: layers of a calendar, entries by request, pending work; and matching in order of time."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def layer(since: int, until: int) -> str:
    """month if the days of the window hold a whole calendar month, else week for a whole ISO week, else day."""
    first = datetime.fromtimestamp(since, UTC).date()
    after = datetime.fromtimestamp(until, UTC).date() + timedelta(1)
    month = first if first.day == 1 else _next_month(first)
    week = first + timedelta(-first.weekday() % 7)
    return "month" if _next_month(month) <= after else "week" if week + timedelta(7) <= after else "day"


def _next_month(d: date) -> date:
    return date(d.year + d.month // 12, d.month % 12 + 1, 1)


def in_layer(entries: DataFrame, since: int, until: int) -> DataFrame:
    """Entries of the window counted by the layer that fits it: start, team, n, first and last id."""
    kept = entries.filter(F.col("created_at").between(since, until))
    start = F.date_format(F.date_trunc(layer(since, until), F.to_timestamp("date")), "yyyy-MM-dd")
    at = F.struct("created_at", "id")
    return kept.groupBy(start.alias("start"), "team").agg(F.count("*").alias("n"), F.min_by("id", at).alias("first"), F.max_by("id", at).alias("last"))


def listed(entries: DataFrame, since: int, until: int) -> DataFrame:
    """Entries of the window in their order."""
    return entries.filter(F.col("created_at").between(since, until)).orderBy("date", "created_at", "team", "id")


def by_request(entries: DataFrame, ids: list[str]) -> DataFrame:
    """Entries of each requested id in the order of the request: the exact id, else all of a date, else all that start with it.

    The request is a short literal list, so every entry is tested in one scan.
    """
    asked = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(v).alias("want")) for k, v in enumerate(ids)))
    hit = F.filter(asked, lambda w: F.startswith(F.col("id"), w["want"]) | (F.col("date") == w["want"]))
    found = entries.withColumn("hit", F.explode(hit)).select(*entries.columns, "hit.place", (F.col("id") == F.col("hit.want")).alias("exact"))
    exact = F.max("exact").over(W.partitionBy("place").orderBy(F.desc("exact")).rowsBetween(W.unboundedPreceding, 0))
    return found.withColumn("any", exact).filter("exact or not any").drop("any").orderBy("place", "id")


def pending(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows (id, hash) that are new, or whose stored hash is another."""
    old = stored.select("id", F.col("hash").alias("old"))
    return current.join(old, "id", "left").filter("old is null or old <> hash").select("id", "hash", F.when(F.col("old").isNull(), "new").otherwise("changed").alias("why"))


def facts(rows: DataFrame, categories: dict[str, Column]) -> DataFrame:
    """id, category, position (from 1) and fact, from an array column for each category; empty facts are left out."""

    def tagged(category: str, facts_: Column) -> Column:
        return F.transform(facts_, lambda x, i: F.struct(F.lit(category).alias("category"), (i + 1).alias("position"), F.trim(x).alias("fact")))

    tagged_all = [tagged(k, c) for k, c in categories.items()]
    return rows.select("id", F.explode(F.concat(*tagged_all)).alias("f")).select("id", "f.*").filter("fact <> ''")


def greedy_match(tasks: DataFrame, ends: DataFrame, slack: int) -> DataFrame:
    """Each task (key, id, sec) in order of time takes the first unused end (key, id, sec) later than ``slack`` before it.

    Since the bounds only rise, task i's place among the ends is the larger of its bound's place and the
    place after task i - 1's, so it is i plus the running maximum of (place of bound j) - j: windows only,
    and rows of one key stream through one sort. ``match`` is null where no end is left.
    """
    t = tasks.select("key", "id", (F.col("sec") - slack).alias("at"), F.lit(1).alias("task"))
    e = ends.select("key", "id", F.col("sec").alias("at"), F.lit(0).alias("task"))
    so_far = W.partitionBy("key").orderBy("at", "task", "id").rowsBetween(W.unboundedPreceding, 0)
    rows = t.unionByName(e).select("*", F.sum("task").over(so_far).alias("i"), F.sum(1 - F.col("task")).over(so_far).alias("before"))
    reached = F.max(F.when(F.col("task") == 1, F.col("before") + 1 - F.col("i"))).over(so_far)
    rows = rows.withColumn("place", F.when(F.col("task") == 1, F.col("i") + reached).otherwise(F.col("before")))
    by_place = lambda k, name: rows.filter(F.col("task") == k).select("key", "place", F.col("id").alias(name))
    return by_place(1, "task").join(by_place(0, "match"), ["key", "place"], "left").select("key", "task", "match")
