"""Commit and pull-request activity. Every operator that looks back in time takes ``as_of`` (unix seconds)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DAY = 86400


def touched(commits: DataFrame, diffs: DataFrame, as_of: int, days: int) -> DataFrame:
    """Changed paths of the time's commits; these cut the changes before they are made distinct."""
    own = commits.filter(F.col("timestamp").between(as_of - days * DAY, as_of))
    return diffs.join(own.select(F.col("id").alias("commit_id")), "commit_id", "left_semi").join(own, F.col("commit_id") == own.id)


def hotspots(commits, diffs, as_of, days=90, k=20) -> DataFrame:
    return touched(commits, diffs, as_of, days).groupBy("path").agg(F.count("*").alias("changes")).orderBy(F.desc("changes"), "path").limit(k)


def hotspot_messages(commits, diffs, as_of, days=90, k=20, n=5) -> DataFrame:
    """The latest ``n`` distinct messages of each hotspot."""
    rows = touched(commits, diffs, as_of, days)
    hot = rows.groupBy("path").agg(F.count("*").alias("changes")).orderBy(F.desc("changes"), "path").limit(k)
    last = rows.join(F.broadcast(hot), "path").groupBy("path", "message").agg(F.max("timestamp").alias("last"))
    rank = F.row_number().over(W.partitionBy("path").orderBy(F.desc("last"), "message"))
    return last.withColumn("rank", rank).filter(F.col("rank") <= n)


def contention(commits, diffs, as_of, days=14) -> DataFrame:
    """Paths changed from more than one repository."""
    rows = touched(commits, diffs, as_of, days).groupBy("path").agg(F.array_join(F.array_sort(F.collect_set(F.col("repo_id").cast("string"))), ",").alias("repos"), F.count_distinct("repo_id").alias("n_repos"))
    return rows.filter("n_repos > 1")


def recent_commits(commits, diffs, k=20) -> DataFrame:
    """The latest commits with their paths."""
    top = commits.orderBy(F.desc("timestamp"), "id").limit(k)
    paths = diffs.join(F.broadcast(top.select(F.col("id").alias("commit_id"))), "commit_id").groupBy("commit_id").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("files"))
    return top.join(paths, top.id == paths.commit_id, "left").select("id", "author", "message", "timestamp", F.coalesce("files", F.lit("")).alias("files"))


def ownership(commits, diffs) -> DataFrame:
    """Commits and last change of each author of a path."""
    return diffs.join(commits, diffs.commit_id == commits.id).groupBy("path", "author").agg(F.count("*").alias("commits"), F.max("timestamp").alias("last"), F.max_by("hash", F.struct("timestamp", "hash")).alias("last_hash"))


def dominant_author(commits, diffs, least=2) -> DataFrame:
    """The author with the most commits to a path, then the latest, then the first by name."""
    rank = F.row_number().over(W.partitionBy("path").orderBy(F.desc("commits"), F.desc("last"), "author"))
    return ownership(commits, diffs).filter(F.col("commits") >= least).withColumn("rank", rank).filter("rank = 1").drop("rank")


def triage(prs, comments, pr_commits, as_of) -> DataFrame:
    """Counters, last activity, age and stalled days of open pull requests."""
    c = comments.groupBy("pr_id").agg(
        F.count("*").alias("n_comments"), F.count_distinct(F.when(F.col("path").isNotNull(), F.col("author"))).alias("reviewers"),
        F.count_distinct(F.when(F.col("path").isNull(), F.col("author"))).alias("discussants"), F.max("created_at").alias("last_comment"))
    k = pr_commits.groupBy("pr_id").agg(F.count("*").alias("n_commits"))
    rows = prs.filter("state = 'open'").join(c, prs.id == c.pr_id, "left").drop("pr_id").join(k, F.col("id") == k.pr_id, "left")
    last = F.greatest(F.coalesce("updated_at", F.lit(0)), F.coalesce("last_comment", F.lit(0)))
    days = lambda t: F.when((t > 0) & (t < as_of), F.floor((as_of - t) / DAY)).otherwise(0).cast("long")
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return rows.select("number", "author", *map(zero, ("n_comments", "reviewers", "discussants", "n_commits")), last.alias("last_activity"), days(F.col("created_at")).alias("age_days"), days(last).alias("stalled_days"))


def pr_commit_list(pr_commits, commits) -> DataFrame:
    """Commits of pull requests; a sha without a commit stays, with nulls."""
    return pr_commits.join(commits, pr_commits.sha == commits.hash, "left").select("pr_id", "sha", "author", "timestamp")


def direct_commits(commits, pr_commits) -> DataFrame:
    """Commits that belong to no pull request."""
    return commits.join(pr_commits.select(F.col("sha").alias("hash")), "hash", "left_anti")


def by_day(prs, commits, issues) -> DataFrame:
    """Events of each day: pull requests by merge or else update, issues by update, commits by time."""
    of = lambda name, at: (F.lit(name).alias("type"), F.to_date(F.timestamp_seconds(at)).alias("day"))
    rows = prs.select(*of("pr", F.coalesce("merged_at", "updated_at"))).unionByName(issues.select(*of("issue", F.col("updated_at")))).unionByName(commits.select(*of("commit", F.col("timestamp"))))
    return rows.groupBy("day", "type").agg(F.count("*").alias("n")).withColumn("day", F.col("day").cast("string"))


def triaged(prs, comments, k) -> DataFrame:
    """The first ``k`` open pull requests in each order: longest without activity, oldest, most discussed; ties by number."""
    c = comments.groupBy("pr_id").agg(F.count("*").alias("comments"), F.max("created_at").alias("last"))
    last = F.greatest(F.coalesce("updated_at", F.lit(0)), F.coalesce("last", F.lit(0)))
    rows = prs.filter("state = 'open'").join(c, prs.id == c.pr_id, "left").select("number", "created_at", last.alias("last_activity"), F.coalesce("comments", F.lit(0)).alias("comments"))
    orders = {"stalled": ["last_activity"], "age": ["created_at"], "activity": [F.desc("comments"), F.desc("last_activity")]}
    place = lambda order: F.row_number().over(W.orderBy(*order, "number"))  # noqa: E731  (of k rows)
    return reduce(DataFrame.unionByName, [rows.orderBy(*o, "number").limit(k).select(F.lit(by).alias("by"), "*", place(o).alias("place")) for by, o in orders.items()])


def with_blobs(changes, blobs) -> DataFrame:
    """Changes with the blobs before and after; a side that is missing or unknown is null."""
    side = lambda p: blobs.select(F.col("id").alias(f"{p}_id"), F.col("language").alias(f"{p}_language"))
    rows = changes.join(side("old"), F.col("old_blob_id") == F.col("old_id"), "left").join(side("new"), F.col("new_blob_id") == F.col("new_id"), "left")
    return rows.select("commit_id", "path", "old_language", "new_language", "old_id", "new_id")


def in_window(prs, since, until) -> DataFrame:
    """Pull requests created, updated or merged in the window, latest first by merge, update or creation."""
    any_ = F.col("updated_at").between(since, until) | F.col("merged_at").between(since, until) | F.col("created_at").between(since, until)
    return prs.filter(any_).select("number", "state", F.coalesce("merged_at", "updated_at", "created_at").alias("at"))


def review_groups(comments) -> DataFrame:
    """Comments of each author of a pull request by kind, groups in order of their first comment."""
    kind = F.when(F.coalesce("path", F.lit("")) != "", "review").otherwise("discussion")
    g = comments.groupBy("pr_id", "author", kind.alias("kind")).agg(F.count("*").alias("n"), F.min("created_at").alias("first"))
    return g.withColumn("position", F.row_number().over(W.partitionBy("pr_id").orderBy("first", "author", "kind")))
