"""Histories and their layers: walks over new commits, and what overlays leave of a base."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.tables import materialise, numbered


def new_commits(parents: DataFrame, tips: DataFrame, known: DataFrame, depth: int) -> DataFrame:
    """Commits that can be reached from ``tips`` (commit_id) over ``parents`` (commit_id, parent_id) without passing a known one.

    commit_id; near and far, the least and the most steps from a tip; number, from 1, oldest first: the
    most steps come first, so every commit comes after all its parents, however merges join. The walk
    ends after ``depth`` steps, and ``cut`` tells the commits whose parents it left out for that. Each
    step is one join from a front that is written and holds a commit once, so a step never has more rows
    than there are new commits.
    """
    known = known.select("commit_id").distinct()
    front = materialise(tips.select("commit_id").distinct().join(known, "commit_id", "left_anti"))
    steps = [front.withColumn("step", F.lit(0))]
    for k in range(1, depth + 1):
        above = parents.join(front, "commit_id").select(F.col("parent_id").alias("commit_id")).distinct().join(known, "commit_id", "left_anti")
        front = materialise(above)
        if front.isEmpty():
            break
        steps.append(front.withColumn("step", F.lit(k)))
    reached = reduce(DataFrame.unionByName, steps).groupBy("commit_id").agg(F.min("step").alias("near"), F.max("step").alias("far"))
    reached = materialise(reached)
    left_out = parents.join(reached.filter(F.col("far") == depth).select("commit_id"), "commit_id").select("commit_id", F.col("parent_id").alias("p"))
    there = reached.select(F.col("commit_id").alias("p")).unionByName(known.select(F.col("commit_id").alias("p")))
    cut = left_out.join(there, "p", "left_anti").select("commit_id").distinct().withColumn("cut", F.lit(True))
    return numbered(reached.join(cut, "commit_id", "left").withColumn("cut", F.coalesce("cut", F.lit(False))), F.desc("far"), F.col("commit_id"))


def overlaid(base: DataFrame, overlays: list[DataFrame], key: str = "path") -> DataFrame:
    """``base`` as the overlays show it: where overlays have a key, the last of them that does has all its rows.

    Overlays have the base's columns, or some of them, and ``deleted``: a key whose rows are deleted is
    gone. Only the overlays' keys meet the base, which stays where it is if they are few.
    """
    if not overlays:
        return base
    gone = [o if "deleted" in o.columns else o.withColumn("deleted", F.lit(False)) for o in overlays]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [o.withColumn("_layer", F.lit(k)) for k, o in enumerate(gone)])
    top = every.groupBy(key).agg(F.max("_layer").alias("_layer"))
    shown = every.join(top, [key, "_layer"]).filter(~F.coalesce("deleted", F.lit(False))).drop("_layer", "deleted")
    under = base.join(top.select(key), key, "left_anti")
    return under.unionByName(shown, allowMissingColumns=True).select(*base.columns)
