"""Queries for reports: feedback, merges, filters, rollups and annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.functions import text as T
from weir.operators import activity as A
from weir.operators import code as D
from weir.operators import reports as R
from weir.operators import search as Q
from weir.operators import texts as X
from weir.plans.detectors import annotations, detector
from weir.queries_text import _JAC, _LOW, _PAIRS
from weir.registry import register

_own = lambda t, topic: t.filter(F.col("topic") == topic)


@register("SELECT anchor, mark, raised, resolved, resolved IS NULL OR raised > resolved AS open FROM (SELECT file AS anchor, arg_max(id, (sec, id)) AS mark, max(sec) AS raised FROM {murmurs} WHERE topic = 'error' GROUP BY 1) LEFT JOIN (SELECT file AS anchor, max(sec) AS resolved FROM {murmurs} WHERE topic = 'purchase' GROUP BY 1) USING (anchor)")
def j29_reviews(murmurs):
    rows = murmurs.withColumnRenamed("file", "anchor")
    return R.reviews(_own(rows, "error"), _own(rows, "purchase"))


@register("SELECT open, count(*) AS n FROM (SELECT resolved IS NULL OR raised > resolved AS open FROM (SELECT file AS anchor, max(sec) AS raised FROM {murmurs} WHERE topic = 'error' GROUP BY 1) LEFT JOIN (SELECT file AS anchor, max(sec) AS resolved FROM {murmurs} WHERE topic = 'purchase' GROUP BY 1) USING (anchor)) GROUP BY 1")
def r31_feedback_digest(murmurs):
    return j29_reviews(murmurs).groupBy("open").agg(F.count("*").alias("n"))


@register("WITH a AS (SELECT file, author, 1 AS tier, count(*) AS n FROM {murmurs} WHERE topic = 'error' AND value > 100 GROUP BY 1, 2), b AS (SELECT file, author, 2 AS tier, count(*) AS n FROM {murmurs} WHERE topic = 'click' AND value > 80 GROUP BY 1, 2), c AS (SELECT file, author, 3 AS tier, count(*) AS n FROM {murmurs} WHERE topic = 'view' GROUP BY 1, 2) SELECT * FROM a UNION ALL SELECT * FROM b WHERE file NOT IN (SELECT file FROM a) UNION ALL SELECT * FROM c WHERE file NOT IN (SELECT file FROM a) AND file NOT IN (SELECT file FROM b)")
def j27_merged(murmurs):
    tier = lambda k, topic, least: murmurs.filter((F.col("topic") == topic) & (F.col("value") > least)).groupBy("file", "author").agg(F.lit(k).alias("tier"), F.count("*").alias("n")).select("file", "author", "tier", "n")
    return R.merged([tier(1, "error", 100), tier(2, "click", 80), tier(3, "view", -1)], "file")


@register("SELECT id, author, topic FROM {murmurs} WHERE topic <> 'click' OR author = 'u3'")
def p22_visible(murmurs):
    return R.visible_to(murmurs, "click", "u3").select("id", "author", "topic")


@register("SELECT id, status, priority, owner FROM {work_items} WHERE status IN ('open', 'in_progress') AND priority = 2 AND created_at >= TIMESTAMP '1995-01-01' AND created_at < TIMESTAMP '1997-01-01' ORDER BY priority, created_at DESC, id LIMIT 200")
def p23_o7_wanted(work_items):
    return R.wanted(work_items, "open, in_progress", 2, since="1995-01-01", until="1997-01-01").orderBy("priority", F.desc("created_at"), "id").limit(200).select("id", "status", "priority", "owner")


@register("WITH g AS (SELECT author, topic, count(*) AS n, CASE topic WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS k FROM {murmurs} WHERE value > 150 GROUP BY 1, 2) SELECT author, topic, n FROM g QUALIFY row_number() OVER (PARTITION BY author ORDER BY k, topic) = 1")
def p28_strongest(murmurs):
    return R.strongest(murmurs.filter("value > 150"), ["error", "purchase"])


@register("SELECT file, topic, id, value FROM {murmurs} QUALIFY row_number() OVER (PARTITION BY file, topic ORDER BY value DESC, id) = 1")
def u7_best_first(murmurs):
    return R.best_first(murmurs.select("file", "topic", "id", "value"), ["file", "topic"], "value", "id")


@register("SELECT id, sec, author FROM {murmurs} WHERE topic IN ('click', 'view', 'error') ORDER BY sec DESC, id DESC LIMIT 50")
def o6_newest_of_stores(murmurs):
    return R.newest_of([_own(murmurs, t).select("id", "sec", "author") for t in ("click", "view", "error")], 50)


@register("WITH e AS (SELECT *, lag(topic) OVER (PARTITION BY author ORDER BY sec, id) AS before FROM {murmurs} WHERE topic IN ('signup', 'purchase')), k AS (SELECT *, lead(sec) OVER (PARTITION BY author ORDER BY sec, id) AS until FROM e WHERE topic <> coalesce(before, 'purchase')), r AS (SELECT author, sec AS lo, until AS hi FROM k WHERE topic = 'signup') SELECT author, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM r WHERE r.author = m.author AND m.sec >= lo AND (hi IS NULL OR m.sec < hi))) AS masked FROM {murmurs} m GROUP BY 1")
def a37_masked(murmurs):
    return R.masked(murmurs, D.pauses(murmurs, "signup", "purchase"))


@register(f"WITH p AS ({_PAIRS}), s AS (SELECT session, list_distinct({_LOW.format('ref')}) AS a, list_distinct({_LOW.format('cand')}) AS b FROM p), k AS (SELECT session, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE ({_JAC.format('a', 'b')}) * CASE WHEN len(b) / len(a) < 0.3 THEN 0.5 WHEN len(b) / len(a) > 3.0 THEN 0.8 ELSE 1.0 END END AS score FROM s) SELECT session, count(*) AS n, round(avg(score), 6) AS mean, round(min(score), 6) AS least, round(max(score), 6) AS most, min(score) >= 0.05 AS passed FROM k GROUP BY 1")
def a29_evaluation(transcript):
    score = X.summary_score(F.col("ref"), F.col("cand"))
    g = X.answers(transcript).withColumn("score", score).groupBy("session").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"))
    return g.select("session", "n", F.round("mean", 6).alias("mean"), F.round("least", 6).alias("least"), F.round("most", 6).alias("most"), (F.col("least") >= 0.05).alias("passed"))


@register("SELECT 'pr' AS type, count(*) AS n, count(*) FILTER (WHERE state = 'open') AS open, count(DISTINCT author) AS authors FROM {pull_requests} UNION ALL SELECT 'commit', count(*), 0, count(DISTINCT author) FROM {commits}")
def a12_activity_counts(pull_requests, commits):
    a = pull_requests.agg(F.count("*").alias("n"), F.count_if(F.col("state") == "open").alias("open"), F.count_distinct("author").alias("authors"))
    b = commits.agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("open"), F.count_distinct("author").alias("authors"))
    return a.select(F.lit("pr").alias("type"), "*").unionByName(b.select(F.lit("commit").alias("type"), "*"))


@register("SELECT author, file, count(*) AS n, round(sum(CASE WHEN topic <> 'error' THEN value ELSE 0.0 END), 3) AS added, round(sum(CASE WHEN topic = 'error' THEN value ELSE 0.0 END), 3) AS removed FROM {murmurs} GROUP BY 1, 2")
def a26_changes_by_path(murmurs):
    part = lambda c: F.round(F.sum(F.when(c, F.col("value")).otherwise(0.0)), 3)
    return murmurs.groupBy("author", "file").agg(F.count("*").alias("n"), part(F.col("topic") != "error").alias("added"), part(F.col("topic") == "error").alias("removed"))


@detector
def shared_file(murmurs):
    """Files with at least four authors."""
    g = murmurs.groupBy("file").agg(F.count_distinct("author").alias("n")).filter("n >= 4")
    return g.select(F.lit("files").alias("section"), F.lit("collision").alias("kind"), F.concat("file", F.lit(" has "), F.col("n").cast("string"), F.lit(" authors")).alias("why"))


@detector
def expert(commits, diffs):
    """Paths with a dominant author."""
    return A.dominant_author(commits, diffs).select(F.lit("people").alias("section"), F.lit("expert").alias("kind"), F.concat("author", F.lit(" knows "), "path").alias("why"))


@register("WITH o AS (SELECT path, author, count(*) AS n, max(timestamp) AS last FROM {diffs} d JOIN {commits} c ON d.commit_id = c.id GROUP BY 1, 2 HAVING count(*) >= 2) SELECT 'people' AS section, 'expert' AS kind, author || ' knows ' || path AS why FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, last DESC, author) = 1) UNION SELECT 'files', 'collision', file || ' has ' || count(DISTINCT author) || ' authors' FROM {murmurs} GROUP BY file HAVING count(DISTINCT author) >= 4")
def x2_r2_annotations(murmurs, commits, diffs):
    return annotations(["shared_file", "expert"], murmurs=murmurs, commits=commits, diffs=diffs)


_AS_OF = 1704067200 + 25 * 86400


@register(f"SELECT isoyear(w) || '-W' || lpad(CAST(week(w) AS VARCHAR), 2, '0') AS week, n FROM (SELECT date_trunc('week', ts) AS w, count(*) AS n FROM {{murmurs}} GROUP BY 1) WHERE epoch(CAST(w AS TIMESTAMP)) + 604800 <= {_AS_OF}")
def r7_completed_weeks(murmurs):
    return R.completed_weeks(murmurs, _AS_OF)


@register("SELECT strftime(m, '%Y-%m') AS month, n FROM (SELECT date_trunc('month', to_timestamp(timestamp) AT TIME ZONE 'UTC') AS m, count(*) AS n FROM {commits} GROUP BY 1) WHERE epoch(CAST(m + INTERVAL 1 MONTH AS TIMESTAMP)) <= 893462400")
def r7_completed_months(commits):
    return R.completed_months(commits.select(F.timestamp_seconds("timestamp").alias("ts")), 893462400)


@register("SELECT author, strftime(max(ts), '%Y-%m-%d') AS mark FROM {murmurs} GROUP BY 1")
def r6_high_water_mark(murmurs):
    return murmurs.groupBy("author").agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("mark"))


@register("SELECT id, round(CAST(CASE WHEN file IN ('pkg3/d3/f1', 'pkg4/d11/f2') THEN 1.0 ELSE 0.6 END AS DOUBLE) * 0.5, 6) AS score FROM {murmurs} WHERE file IN ('pkg3/d3/f1', 'pkg4/d11/f2') OR topic = 'error'")
def f13_relevance(murmurs):
    return R.relevance(murmurs, ["pkg3/d3/f1", "pkg4/d11/f2"], ["error"], 0.5)


@register(f"WITH p AS ({_PAIRS}) SELECT session, seq, array_to_string(list_concat(list_concat(['--- a/' || session, '+++ b/' || session], list_transform(string_split(ref, chr(10))[1:100], lambda x: '-' || x)), list_transform(string_split(cand, chr(10))[1:100], lambda x: '+' || x)), chr(10)) AS diff FROM p")
def f8_diff_text(transcript):
    return X.answers(transcript).select("session", "seq", T.diff_text(F.col("session").cast("string"), F.col("ref"), F.col("cand")).alias("diff"))


@register("SELECT path, substr(hash, 1, 10) AS hash, author, timestamp, commit_id FROM {diffs} d JOIN {commits} c ON c.id = d.commit_id WHERE contains(lower(path), 'economy') AND NOT contains(lower(path), 'brand_1/') AND contains(lower(author), '00001') AND timestamp > epoch(TIMESTAMP '1995-01-01') ORDER BY timestamp DESC, commit_id, path LIMIT 60")
def ql_diff(diffs, commits):
    return Q.search_diffs(diffs, commits, ["economy"], not_file="brand_1/", author="00001", after="1995-01-01", limit=60)
