"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weir.llm.common import materialise


def _pairs(rows: DataFrame, pair) -> DataFrame:
    return rows.select(pair.alias("p")).filter("p is not null").select("p.*").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (long). Returns node, component (the least node that it reaches); nodes without an edge are left out.

    A star gives each neighbour of a node the node's least neighbour, which a running window over the
    sorted neighbours knows from its first row; so nothing is held for a node with very many. Each round
    shortens the paths by at least half for most graphs; stars take two rounds.
    """
    state = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    first = F.first("b").over(W.partitionBy("a").orderBy("b").rowsBetween(W.unboundedPreceding, 0))
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    before = mark(state)
    while before[0]:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("m", F.least("a", first))
        large = _pairs(both, F.when(F.col("b") > F.col("a"), pair("b", "m")).when(F.col("b") == F.col("m"), pair("a", "b"))).withColumn("m", first)
        state = materialise(_pairs(large, F.when(F.col("b") > F.col("m"), pair("b", "m")).otherwise(pair("a", "m"))))
        now = mark(state)
        if now == before:
            break
        before = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
