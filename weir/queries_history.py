"""Queries on dated entries, matching in time, excerpts and the rest of the search language."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.operators import history as H
from weir.operators import search as Q
from weir.operators import texts as X
from weir.queries_text import _JAC
from weir.registry import register

SINCE = 1704067200 + 2 * 86400
MONTH, WEEK = SINCE + 62 * 86400, SINCE + 12 * 86400
ASKED = ["2024-01-05", "2024-01-03-1", "2024-01-1", "no-such-id"]
TERMS = ["the", "und", "que", "with"]
_TIPS = "SELECT DISTINCT path, blob_id FROM {file_revs} WHERE commit_id IN (SELECT commit_id FROM {refs} WHERE name IN ('refs/heads/main', 'refs/heads/master'))"
_ASKED = ", ".join(f"({k}, '{v}')" for k, v in enumerate(ASKED))
_LAYER = "SELECT strftime(date_trunc('{}', CAST(date AS DATE)), '%Y-%m-%d') AS start, team, count(*) AS n, arg_min(id, (created_at, id)) AS first, arg_max(id, (created_at, id)) AS last FROM {{history}} WHERE created_at BETWEEN {} AND {} GROUP BY 1, 2"


@register("""WITH t AS (SELECT author, id, sec, row_number() OVER (PARTITION BY author ORDER BY sec, id) AS i FROM {murmurs} WHERE topic = 'click'), s AS (SELECT author, id, sec, row_number() OVER (PARTITION BY author ORDER BY sec, id) AS p FROM {murmurs} WHERE topic = 'purchase'),
    f AS (SELECT t.author, t.id, t.i, count(s.id) AS n FROM t LEFT JOIN s ON s.author = t.author AND s.sec <= t.sec - 30 GROUP BY 1, 2, 3), g AS (SELECT *, i + max(n + 1 - i) OVER (PARTITION BY author ORDER BY i) AS place FROM f)
    SELECT g.author AS key, g.id AS task, s.id AS match FROM g LEFT JOIN s ON s.author = g.author AND s.p = g.place""")
def j11_greedy_match(murmurs):
    own = lambda topic: murmurs.filter(F.col("topic") == topic).select(F.col("author").alias("key"), "id", "sec")
    return H.greedy_match(own("click"), own("purchase"), 30)


@register(f"WITH g AS (SELECT author, file, count(*) FILTER (WHERE id % 2 = 0) AS a, count(*) FILTER (WHERE id % 2 = 1) AS b, coalesce(list(DISTINCT topic) FILTER (WHERE id % 2 = 0), []) AS ta, coalesce(list(DISTINCT topic) FILTER (WHERE id % 2 = 1), []) AS tb FROM {{murmurs}} GROUP BY 1, 2) SELECT author, file, round(CASE WHEN a = 0 AND b = 0 THEN 1.0 WHEN a = 0 THEN 0.5 WHEN b = 0 THEN 0.0 ELSE 0.6 * (1 - abs(a - b) / greatest(a, b)) + 0.4 * ({_JAC.format('ta', 'tb')}) END, 6) AS score FROM g")
def f11_moments(murmurs):
    side = lambda k: F.when(F.pmod("id", F.lit(2)) == k, F.col("topic"))
    g = murmurs.groupBy("author", "file").agg(F.count(side(0)).alias("a"), F.count(side(1)).alias("b"), F.collect_set(side(0)).alias("ta"), F.collect_set(side(1)).alias("tb"))
    return g.select("author", "file", F.round(X.moments_score(F.col("a"), F.col("b"), F.col("ta"), F.col("tb")), 6).alias("score"))


@register("WITH w AS (SELECT id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS w FROM {ledger}), h AS (SELECT id, len(w) AS n, len(list_filter(w, lambda x: x IN ('the', 'und', 'que', 'with'))) AS hits FROM w) SELECT id, CAST(0.85 AS DOUBLE) * (0.5 + hits / n) AS score FROM h WHERE hits > 0")
def f12_doc_score(ledger):
    return ledger.select("id", X.doc_score(F.col("content"), TERMS).alias("score")).filter("score is not null")


@register(_LAYER.format("month", SINCE, MONTH))
def r3_layer_month(history):
    return H.in_layer(history, SINCE, MONTH)


@register(_LAYER.format("week", SINCE, WEEK))
def r3_layer_week(history):
    return H.in_layer(history, SINCE, WEEK)


@register(f"SELECT * FROM {{history}} WHERE created_at BETWEEN {SINCE} AND {WEEK} ORDER BY date, created_at, team, id")
def r4_listed(history):
    return H.listed(history, SINCE, WEEK)


@register(f"WITH f AS (SELECT h.*, CAST(place AS INTEGER) AS place, id = want AS exact FROM {{history}} h JOIN (VALUES {_ASKED}) a(place, want) ON starts_with(id, want) OR date = want) SELECT * FROM f QUALIFY exact OR NOT bool_or(exact) OVER (PARTITION BY place)")
def r5_by_request(history):
    return H.by_request(history, ASKED)


@register("SELECT id, left(sha256(content), 24) AS hash, CASE WHEN id % 3 = 0 THEN 'changed' ELSE 'new' END AS why FROM {ledger} WHERE content IS NOT NULL AND id % 3 <> 1")
def r8_pending(ledger):
    now = ledger.filter("content is not null").select("id", F.substring(F.sha2("content", 256), 1, 24).alias("hash"))
    stored = now.filter("id % 3 < 2").withColumn("hash", F.when(F.col("id") % 3 == 0, F.reverse("hash")).otherwise(F.col("hash")))
    return H.pending(now, stored)


@register("""WITH l AS (SELECT id, string_split(content, chr(10)) AS l FROM {ledger} WHERE content IS NOT NULL), c AS (SELECT id, 'question' AS category, list_filter(l, lambda x: ends_with(x, '?')) AS f FROM l UNION ALL SELECT id, 'decision', list_filter(l, lambda x: ends_with(x, '.')) FROM l),
    u AS (SELECT id, category, unnest(f) AS fact, unnest(range(1, len(f) + 1)) AS position FROM c) SELECT id, category, CAST(position AS INTEGER) AS position, trim(fact) AS fact FROM u WHERE trim(fact) <> ''""")
def r9_facts(ledger):
    lines = F.split("content", "\n")
    kept = lambda end: F.filter(lines, lambda x: F.endswith(x, F.lit(end)))
    return H.facts(ledger.filter("content is not null"), {"question": kept("?"), "decision": kept(".")})


@register(r"""WITH a AS (SELECT id, content, instr(lower(content), 'that') AS place, length(content) AS n FROM {ledger} WHERE contains(lower(content), 'that')), w AS (SELECT *, greatest(1, place - 80) AS lo, least(n, greatest(1, place - 80) + 159) AS hi FROM a), p AS (SELECT *, substr(content, CAST(lo AS BIGINT), CAST(hi - lo + 1 AS BIGINT)) AS part FROM w),
    q AS (SELECT *, CASE WHEN lo > 1 THEN regexp_replace(part, '^[^ \t\r\n]*[ \t\r\n]+', '') ELSE part END AS x FROM p), r AS (SELECT *, CASE WHEN hi < n THEN regexp_replace(x, '[ \t\r\n]+[^ \t\r\n]*\z', '') ELSE x END AS y FROM q)
    SELECT id, CASE WHEN lo > 1 THEN '...' ELSE '' END || trim(regexp_replace(y, '[ \t\r\n]+', ' ', 'g')) || CASE WHEN hi < n THEN '...' ELSE '' END AS snippet FROM r""")
def f4_excerpts(ledger):
    return X.excerpts(ledger, "that")


@register("SELECT date, kind, count(*) AS n, min(id) AS first FROM {history} WHERE date >= '2024-01-10' GROUP BY 1, 2")
def r10_pending_by_day(history):
    return history.filter("date >= '2024-01-10'").groupBy("date", "kind").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@register("SELECT number, title, author, state, updated_at FROM {issues} WHERE (contains(lower(title), 'urgent') OR contains(lower(body), 'urgent') OR number IN (SELECT issue_id FROM {issue_comments} WHERE contains(lower(body), 'urgent')) OR contains(lower(title), 'flag r') OR contains(lower(body), 'flag r') OR number IN (SELECT issue_id FROM {issue_comments} WHERE contains(lower(body), 'flag r'))) AND state = 'open' AND updated_at > epoch(TIMESTAMP '1995-01-01') ORDER BY updated_at DESC, number LIMIT 80")
def ql_issues(issues, issue_comments):
    return Q.search_issues(issues, issue_comments, ["urgent", "flag R"], state="open", after="1995-01-01", limit=80)


@register("SELECT path, text AS snippet, kind, line, language FROM {comments} c JOIN {blobs} b ON b.id = c.blob_id JOIN (" + _TIPS + ") t ON t.blob_id = c.blob_id WHERE contains(lower(text), 'economy') AND kind = 'block' AND language = 'go' ORDER BY path, line, kind, snippet LIMIT 100")
def ql_comments(comments, blobs, file_revs, refs):
    return Q.search_comments(comments, blobs, file_revs, refs, ["economy"], kind="block", lang="go", limit=100)


@register("WITH f AS (SELECT source || '/' || lpad(CAST(id AS VARCHAR), 12, '0') AS path, lang AS language, string_split(content, chr(10)) AS l, content FROM {ledger}), m AS (SELECT *, list_position(list_transform(l, lambda x: contains(lower(x), 'that')), true) AS line FROM f WHERE contains(lower(content), 'that') AND NOT contains(lower(path), 'src1') AND language = 'en') SELECT path, language, CAST(line AS INTEGER) AS line, left(trim(l[line]), 120) AS snippet FROM m ORDER BY path LIMIT 200")
def ql_code(ledger):
    files = ledger.select(F.concat_ws("/", "source", F.lpad(F.col("id").cast("string"), 12, "0")).alias("path"), F.col("lang").alias("language"), "content")
    return Q.search_code(files, ["that"], lang="en", not_file="src1", limit=200)
