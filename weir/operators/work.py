"""Work items and their dependencies, and walks over call edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weir.tables import materialise


def ready(items: DataFrame, deps: DataFrame) -> DataFrame:
    """Open items without an unfinished item that blocks them, most urgent first."""
    blockers = deps.filter("type = 'blocks'").join(items.filter("status <> 'closed'").select(F.col("id").alias("depends_on_id")), "depends_on_id", "left_semi")
    return items.filter("status = 'open'").join(blockers.select(F.col("issue_id").alias("id")), "id", "left_anti").select("id", "priority", "owner")


def blockers(items: DataFrame, deps: DataFrame) -> DataFrame:
    """All items that an unfinished item names as blocking, whatever their status."""
    d = deps.filter("type = 'blocks'").groupBy(F.col("issue_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("depends_on_id")).cast("array<string>"), ",").alias("blocked_by"))
    return items.filter("status <> 'closed'").join(d, "id").select("id", "status", "blocked_by")


def progress(items: DataFrame, by: str = "owner") -> DataFrame:
    """Items by owner, status or type, and the share of them that is closed."""
    g = items.groupBy(by).agg(F.count("*").alias("n"), F.sum((F.col("status") == "closed").cast("long")).alias("closed"))
    return g.withColumn("rate", F.round(F.col("closed") / F.col("n"), 6))


def evict(items: DataFrame, budget: int) -> DataFrame:
    """Open items of each owner beyond the budget, least urgent and latest first to go."""
    rank = F.row_number().over(W.partitionBy("owner").orderBy("priority", "created_at", "id"))
    return items.filter("status = 'open'").withColumn("rank", rank).filter(F.col("rank") > budget).select("id", "owner", "rank")


def next_claimable(items: DataFrame) -> DataFrame:
    """For each owner the open item to claim next."""
    rank = F.row_number().over(W.partitionBy("owner").orderBy("priority", "created_at", "id"))
    return items.filter("status = 'open'").withColumn("rank", rank).filter("rank = 1").select("owner", "id", "priority")


def reach(edges: DataFrame, start: DataFrame | list[int], depth: int, backwards: bool = False) -> DataFrame:
    """Nodes reached in 1 to ``depth`` hops from ``start`` (node), each with every depth at which it is reached.

    A hop is one join, from a front that is written; a depth holds each node once, so the state never
    exceeds depth times nodes.
    """
    a, b = ("dst", "src") if backwards else ("src", "dst")
    e = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    front = start if isinstance(start, DataFrame) else edges.sparkSession.createDataFrame([(s,) for s in start], "node long")
    out = front.limit(0).withColumn("depth", F.lit(0))
    for k in range(1, depth + 1):
        front = e.join(front, "node").select(F.col("next").alias("node")).distinct()
        front = materialise(front) if k < depth else front
        out = out.unionByName(front.withColumn("depth", F.lit(k)))
    return out
