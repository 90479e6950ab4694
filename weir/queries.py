"""The registered queries over the logical tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.operators import activity as A
from weir.operators import collaboration as C
from weir.operators import search as Q
from weir.operators import sessions as S
from weir.operators import work as K
from weir.registry import ORACLES, QUERIES, register

#: Anchors inside the data's range, in place of the present.
AS_OF = 893462400  # 1998-04-25
SINCE, UNTIL = 1704067200, 1704067200 + 30 * 86400
HOUR = 3600
BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
STOP = frozenset("the and for with that this que las los una des les und der die das".split())
RULES = [("@", r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", "[EMAIL]"), ("key", r"(?i)key[=:] ?[A-Za-z0-9_-]+", "[KEY]"), ("", r"[0-9]{3,}", "[NUMBER]")]

def _recent(days: int) -> str:
    return f"SELECT d.path, c.* FROM {{diffs}} d JOIN {{commits}} c ON d.commit_id = c.id WHERE c.timestamp BETWEEN {AS_OF - days * 86400} AND {AS_OF}"


@register("SELECT substr(hash, 1, 10) AS hash, author, substr(message, 1, 80) AS message, timestamp, id FROM {commits} WHERE lower(message) LIKE '%urgent%' AND lower(author) LIKE '%00001%' AND timestamp > epoch(TIMESTAMP '1995-01-01') ORDER BY timestamp DESC, id LIMIT 50")
def ql_commit(commits):
    return Q.search_commits(commits, ["urgent"], author="00001", after="1995-01-01", limit=50)


@register("SELECT substr(hash, 1, 10) AS hash, author, substr(message, 1, 80) AS message, timestamp, id FROM {commits} WHERE regexp_matches(message, '^[12]-.* O$') AND NOT lower(author) LIKE '%7%' AND timestamp < epoch(TIMESTAMP '1997-06-01') ORDER BY timestamp DESC, id LIMIT 20")
def ql_commit_regex(commits):
    return Q.search_commits(commits, regex="^[12]-.* O$", not_author="7", before="1997-06-01")


@register("SELECT substr(hash, 1, 10) AS hash, author, substr(message, 1, 80) AS message, timestamp, id FROM {commits} WHERE (lower(message) LIKE '%urgent%' OR lower(message) LIKE '%not specified%') AND regexp_matches(lower(author), '^customer.*9$') ORDER BY timestamp DESC, id LIMIT 30")
def ql_commit_or_wildcard(commits):
    return Q.search_commits(commits, ["urgent", "not specified"], author="customer*9", limit=30)


@register("SELECT number, title, author, state, updated_at FROM {pull_requests} WHERE (contains(lower(title), 'high') OR id IN (SELECT pr_id FROM {pr_comments} WHERE contains(lower(body), 'supplier 7'))) AND state = 'merged' AND updated_at > epoch(TIMESTAMP '1996-01-01') ORDER BY updated_at DESC, number LIMIT 90")
def ql_pull_requests(pull_requests, pr_comments):
    return Q.search_pull_requests(pull_requests, pr_comments, ["high", "supplier 7"], state="merged", after="1996-01-01", limit=90)


@register("SELECT substr(hash, 1, 10) AS hash, author, substr(message, 1, 80) AS message, timestamp, id FROM {commits} WHERE contains(message, 'MEDIUM') AND repo_id IN (SELECT id FROM {repos} WHERE contains(name, 'a') AND NOT regexp_matches(name, '^mid.*$')) ORDER BY timestamp DESC, id LIMIT 70")
def p7_p2_commits_of_repos(commits, repos):
    return Q.search_commits(commits, ["MEDIUM"], case=True, repos=repos, repo="a", not_repo="mid*", limit=70)


@register(f"SELECT path, count(*) AS changes FROM ({_recent(90)}) GROUP BY path ORDER BY changes DESC, path LIMIT 20")
def a1_hotspots(commits, diffs):
    return A.hotspots(commits, diffs, AS_OF)


@register(f"WITH r AS ({_recent(90)}), h AS (SELECT path, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, path LIMIT 20), m AS (SELECT path, message, max(timestamp) AS last FROM r WHERE path IN (SELECT path FROM h) GROUP BY 1, 2), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY last DESC, message) AS INTEGER) AS rank FROM m) SELECT path, message, last, rank FROM k WHERE rank <= 5")
def a2_hotspot_messages(commits, diffs):
    return A.hotspot_messages(commits, diffs, AS_OF)


@register(f"SELECT path, string_agg(DISTINCT CAST(repo_id AS VARCHAR), ',' ORDER BY CAST(repo_id AS VARCHAR)) AS repos, count(DISTINCT repo_id) AS n_repos FROM ({_recent(14)}) GROUP BY path HAVING count(DISTINCT repo_id) > 1")
def a3_contention(commits, diffs):
    return A.contention(commits, diffs, AS_OF)


@register("WITH c AS (SELECT * FROM {commits} ORDER BY timestamp DESC, id LIMIT 20) SELECT c.id, author, message, timestamp, coalesce(string_agg(path, ',' ORDER BY path), '') AS files FROM c LEFT JOIN {diffs} d ON d.commit_id = c.id GROUP BY ALL")
def a4_recent_commits(commits, diffs):
    return A.recent_commits(commits, diffs)


@register("SELECT path, author, count(*) AS commits, max(timestamp) AS last, arg_max(hash, (timestamp, hash)) AS last_hash FROM {diffs} d JOIN {commits} c ON d.commit_id = c.id GROUP BY 1, 2")
def a6_ownership(commits, diffs):
    return A.ownership(commits, diffs)


@register("WITH o AS (SELECT path, author, count(*) AS commits, max(timestamp) AS last, arg_max(hash, (timestamp, hash)) AS last_hash FROM {diffs} d JOIN {commits} c ON d.commit_id = c.id GROUP BY 1, 2 HAVING count(*) >= 2) SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY path ORDER BY commits DESC, last DESC, author) = 1")
def w1_dominant_author(commits, diffs):
    return A.dominant_author(commits, diffs)


@register(f"""SELECT number, author, coalesce(n_comments, 0) AS n_comments, coalesce(reviewers, 0) AS reviewers, coalesce(discussants, 0) AS discussants, coalesce(n_commits, 0) AS n_commits, last_activity,
    CASE WHEN created_at > 0 AND created_at < {AS_OF} THEN ({AS_OF} - created_at) // 86400 ELSE 0 END AS age_days, CASE WHEN last_activity > 0 AND last_activity < {AS_OF} THEN ({AS_OF} - last_activity) // 86400 ELSE 0 END AS stalled_days
    FROM (SELECT p.*, n_comments, reviewers, discussants, n_commits, greatest(coalesce(updated_at, 0), coalesce(last_comment, 0)) AS last_activity FROM {{pull_requests}} p
      LEFT JOIN (SELECT pr_id, count(*) AS n_comments, count(DISTINCT CASE WHEN path IS NOT NULL THEN author END) AS reviewers, count(DISTINCT CASE WHEN path IS NULL THEN author END) AS discussants, max(created_at) AS last_comment FROM {{pr_comments}} GROUP BY 1) c ON c.pr_id = p.id
      LEFT JOIN (SELECT pr_id, count(*) AS n_commits FROM {{pr_commits}} GROUP BY 1) k ON k.pr_id = p.id WHERE state = 'open')""")
def a7_a9_triage(pull_requests, pr_comments, pr_commits):
    return A.triage(pull_requests, pr_comments, pr_commits, AS_OF)


@register("SELECT pr_id, sha, author, timestamp FROM {pr_commits} p LEFT JOIN {commits} c ON c.hash = p.sha")
def j6_pr_commit_list(pr_commits, commits):
    return A.pr_commit_list(pr_commits, commits)


@register("SELECT hash, id, repo_id, author, message, timestamp FROM {commits} c WHERE NOT EXISTS (SELECT 1 FROM {pr_commits} p WHERE p.sha = c.hash)")
def j8_direct_commits(commits, pr_commits):
    return A.direct_commits(commits, pr_commits)


@register(f"SELECT number, state, coalesce(merged_at, updated_at, created_at) AS at FROM {{pull_requests}} WHERE updated_at BETWEEN {AS_OF - 604800} AND {AS_OF} OR merged_at BETWEEN {AS_OF - 604800} AND {AS_OF} OR created_at BETWEEN {AS_OF - 604800} AND {AS_OF}")
def p20_in_window(pull_requests):
    return A.in_window(pull_requests, AS_OF - 604800, AS_OF)


@register("SELECT *, CAST(row_number() OVER (PARTITION BY pr_id ORDER BY first, author, kind) AS INTEGER) AS position FROM (SELECT pr_id, author, CASE WHEN coalesce(path, '') <> '' THEN 'review' ELSE 'discussion' END AS kind, count(*) AS n, min(created_at) AS first FROM {pr_comments} GROUP BY 1, 2, 3)")
def a10_review_groups(pr_comments):
    return A.review_groups(pr_comments)


@register("SELECT file, string_agg(DISTINCT author, ',' ORDER BY author) AS authors, count(DISTINCT author) AS n_authors FROM {murmurs} GROUP BY 1 HAVING count(DISTINCT author) >= 2")
def a13_conflicts(murmurs):
    return C.conflicts(murmurs)


@register("SELECT file, string_agg(DISTINCT author, ',' ORDER BY author) AS authors, count(DISTINCT author) AS n_authors FROM {murmurs} GROUP BY 1 HAVING count(DISTINCT author) >= 3")
def a16_hot_files(murmurs):
    return C.conflicts(murmurs, 3)


@register("WITH o AS (SELECT DISTINCT file, author FROM {murmurs}) SELECT a.author, b.author AS other, count(*) AS files FROM o a JOIN o b ON a.file = b.file AND a.author < b.author GROUP BY 1, 2")
def a14_author_pairs(murmurs):
    return C.author_pairs(murmurs)


@register("SELECT author, count(*) AS n, count(DISTINCT file) AS files, max(sec) AS last, arg_max(CASE WHEN topic = 'click' THEN content END, CASE WHEN topic = 'click' THEN (sec, id) END) AS wip FROM {murmurs} GROUP BY 1")
def a15_author_summary(murmurs):
    return C.author_summary(murmurs)


@register("WITH o AS (SELECT DISTINCT file, author FROM {murmurs}), n AS (SELECT file, count(*) AS n FROM o GROUP BY 1) SELECT author, bool_and(n = 1) AS solo, count(*) AS files FROM o JOIN n USING (file) GROUP BY 1")
def a17_solo_silos(murmurs):
    return C.solo_silos(murmurs)


@register("WITH o AS (SELECT DISTINCT author, split_part(file, '/', 1) || '/' || split_part(file, '/', 2) AS package FROM {murmurs}), w AS (SELECT author FROM o GROUP BY 1 HAVING count(*) >= 3), p AS (SELECT a.package, b.package AS other, count(*) AS n, min(a.author) AS author FROM o a JOIN o b ON a.author = b.author AND a.package < b.package GROUP BY 1, 2 HAVING count(*) = 1) SELECT author, package, other FROM p WHERE author IN (SELECT author FROM w)")
def a18_bridges(murmurs):
    return C.bridges(murmurs)


_VELOCITY = f"SELECT s.start, count(m.id) AS murmurs, count(DISTINCT m.id) AS ids FROM (SELECT unnest(range({SINCE}, {UNTIL}, {6 * HOUR})) AS start) s LEFT JOIN {{murmurs}} m ON m.sec >= s.start AND m.sec < s.start + {24 * HOUR} GROUP BY 1"


@register(f"""WITH v AS ({_VELOCITY}), f AS (SELECT start, count(*) AS conflicts FROM (SELECT s.start, m.file FROM (SELECT unnest(range({SINCE}, {UNTIL}, {6 * HOUR})) AS start) s JOIN {{murmurs}} m ON m.sec >= s.start AND m.sec < s.start + {24 * HOUR} GROUP BY 1, 2 HAVING count(DISTINCT m.author) > 1) GROUP BY 1)
    SELECT v.start, murmurs, coalesce(conflicts, 0) AS conflicts, round(CASE WHEN murmurs > 0 THEN coalesce(conflicts, 0) / murmurs ELSE 0.0 END, 6) AS density FROM v LEFT JOIN f USING (start)""")
def w6_velocity(murmurs):
    return C.velocity(murmurs, SINCE, UNTIL, 24 * HOUR, 6 * HOUR)


@register(f"""WITH v AS ({_VELOCITY}), f AS (SELECT start, count(*) AS conflicts FROM (SELECT s.start, m.file FROM (SELECT unnest(range({SINCE}, {UNTIL}, {6 * HOUR})) AS start) s JOIN {{murmurs}} m ON m.sec >= s.start AND m.sec < s.start + {24 * HOUR} GROUP BY 1, 2 HAVING count(DISTINCT m.author) > 1) GROUP BY 1),
    p AS (SELECT v.start, coalesce(conflicts, 0) AS c FROM v LEFT JOIN f USING (start) WHERE murmurs > 0), q AS (SELECT c > lag(c) OVER (ORDER BY start) AS rise, row_number() OVER (ORDER BY start DESC) AS back FROM p)
    SELECT bool_and(CASE WHEN back < 3 THEN rise ELSE true END) AND count(*) = 3 AS escalating FROM q WHERE back <= 3""")
def w7_escalating(murmurs):
    return C.escalating(C.velocity(murmurs, SINCE, UNTIL, 24 * HOUR, 6 * HOUR))


@register("SELECT author, id, CAST(back AS INTEGER) AS back FROM (SELECT author, id, row_number() OVER (PARTITION BY author ORDER BY sec DESC, id DESC) AS back FROM {murmurs}) WHERE back <= 5")
def w10_last_per_key(murmurs):
    return C.last_per_key(murmurs)


@register(f"SELECT id, sec, author FROM {{murmurs}} WHERE sec < {SINCE + 10 * 86400} OR (sec = {SINCE + 10 * 86400} AND id < 500) ORDER BY sec DESC, id DESC LIMIT 51")
def o5_page(murmurs):
    return C.page(murmurs, SINCE + 10 * 86400, 500)


@register(f"SELECT author, id, sec FROM (SELECT *, lead(sec) OVER (PARTITION BY author ORDER BY sec, id) AS next FROM {{murmurs}}) WHERE topic = 'click' AND (next IS NULL OR next - sec >= {HOUR})")
def st1_silences(murmurs):
    return C.silences(murmurs, "click", HOUR)


@register("SELECT CAST(CASE " + " ".join(f"WHEN value <= {b} THEN {i}" for i, b in enumerate(BOUNDS)) + f" ELSE {len(BOUNDS)} END AS INTEGER) AS bucket, count(*) AS n, round(sum(value), 4) AS sum FROM {{murmurs}} GROUP BY 1")
def a24_histogram(murmurs):
    return C.histogram(murmurs, BOUNDS)


@register("SELECT id, priority, owner FROM {work_items} i WHERE status = 'open' AND NOT EXISTS (SELECT 1 FROM {dependencies} d JOIN {work_items} b ON b.id = d.depends_on_id WHERE d.issue_id = i.id AND d.type = 'blocks' AND b.status <> 'closed')")
def j10_ready(work_items, dependencies):
    return K.ready(work_items, dependencies)


@register("SELECT id, status, string_agg(CAST(depends_on_id AS VARCHAR), ',' ORDER BY depends_on_id) AS blocked_by FROM {work_items} JOIN {dependencies} ON issue_id = id WHERE status <> 'closed' AND type = 'blocks' GROUP BY 1, 2")
def a20_blockers(work_items, dependencies):
    return K.blockers(work_items, dependencies)


@register("SELECT owner, count(*) AS n, count(*) FILTER (WHERE status = 'closed') AS closed, round(count(*) FILTER (WHERE status = 'closed') / count(*), 6) AS rate FROM {work_items} GROUP BY 1")
def a19_progress(work_items):
    return K.progress(work_items)


@register("SELECT id, owner, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY priority, created_at, id) AS rank FROM {work_items} WHERE status = 'open') WHERE rank > 3")
def o11_evict(work_items):
    return K.evict(work_items, 3)


@register("SELECT owner, id, priority FROM {work_items} WHERE status = 'open' QUALIFY row_number() OVER (PARTITION BY owner ORDER BY priority, created_at, id) = 1")
def st10_next_claimable(work_items):
    return K.next_claimable(work_items)


@register("RECURSIVE WITH r(node, depth) AS (SELECT DISTINCT src, 1 FROM {edges} WHERE dst = 7 UNION SELECT e.src, r.depth + 1 FROM r JOIN {edges} e ON e.dst = r.node WHERE r.depth < 3) SELECT node, depth FROM r")
def j15_callers(edges):
    return K.reach(edges, [7], 3, backwards=True)


@register("RECURSIVE WITH r(node, depth) AS (SELECT DISTINCT dst, 1 FROM {edges} WHERE src = 7 UNION SELECT e.dst, r.depth + 1 FROM r JOIN {edges} e ON e.src = r.node WHERE r.depth < 3) SELECT node, depth FROM r")
def j16_callees(edges):
    return K.reach(edges, [7], 3)


@register("WITH c AS (SELECT *, CASE WHEN coalesce(lag(type) OVER w, '') <> type THEN 1 ELSE 0 END AS ch FROM {transcript} WINDOW w AS (PARTITION BY session ORDER BY seq)), b AS (SELECT *, sum(ch) OVER (PARTITION BY session ORDER BY seq) AS block FROM c) SELECT session, CAST(block AS BIGINT) AS block, min(type) AS type, min(seq) AS first, max(seq) AS last, count(*) AS n FROM b GROUP BY 1, 2")
def w3_blocks(transcript):
    return S.blocks(transcript)


@register("WITH c AS (SELECT *, CAST(sum(CASE WHEN type = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS BIGINT) AS chapter FROM {transcript}) SELECT session, chapter, min(seq) AS first, max(seq) AS last, count(*) AS n FROM c GROUP BY 1, 2")
def w4_chapters(transcript):
    return S.chapters(transcript)


@register("SELECT *, n < 2 OR answers = 0 OR user_chars < 80 AS low_value FROM (SELECT session, count(*) AS n, count(*) FILTER (WHERE type = 'assistant') AS answers, CAST(coalesce(sum(length(content)) FILTER (WHERE type = 'user'), 0) AS BIGINT) AS user_chars FROM {transcript} GROUP BY 1)")
def p25_low_value(transcript):
    return S.low_value(transcript)


@register("SELECT type, CAST(sum(CASE WHEN strlen(content) > 0 THEN greatest(1, strlen(content) // 4) ELSE 0 END) AS BIGINT) AS tokens, count(*) AS n FROM {transcript} GROUP BY 1")
def a30_tokens(transcript):
    return S.tokens(transcript)


@register("SELECT session, seq, regexp_replace(CASE WHEN contains(lower(b), 'key') THEN regexp_replace(b, '(?i)key[=:] ?[A-Za-z0-9_-]+', '[KEY]', 'g') ELSE b END, '[0-9]{3,}', '[NUMBER]', 'g') AS redacted FROM (SELECT *, CASE WHEN contains(lower(content), '@') THEN regexp_replace(content, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+', '[EMAIL]', 'g') ELSE content END AS b FROM {transcript})")
def redaction(transcript):
    return S.redact(transcript, RULES).select("session", "seq", "redacted")


@register("SELECT id, source, round(0.5 + least(0.5, (least(10, (length(l) - length(replace(l, 'the', ''))) // 3) + least(10, (length(l) - length(replace(l, 'that', ''))) // 4)) / 100), 6) AS score FROM (SELECT *, lower(content) AS l FROM {ledger}) WHERE contains(l, 'the') AND contains(l, 'that') ORDER BY score DESC, id DESC LIMIT 20")
def f2_ledger_search(ledger):
    return S.ledger_search(ledger, "The THAT")


@register("WITH w AS (SELECT source, unnest(regexp_extract_all(lower(content), '[a-z]{3,}')) AS word FROM {ledger}), g AS (SELECT source, word, count(*) AS n FROM w WHERE word NOT IN (" + ", ".join(f"'{w}'" for w in sorted(STOP)) + ") GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS INTEGER) AS rank FROM g) SELECT * FROM r WHERE rank <= 8")
def a31_keywords(ledger):
    return S.keywords(ledger, STOP)


@register("SELECT topic, author, count(*) AS n, max(sec) AS last FROM {murmurs} GROUP BY 1, 2")
def a21_last_by_topic(murmurs):
    return murmurs.groupBy("topic", "author").agg(F.count("*").alias("n"), F.max("sec").alias("last"))


@register("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n, count(DISTINCT author) AS authors FROM {murmurs} GROUP BY 1")
def a33_by_week(murmurs):
    return murmurs.groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week")).agg(F.count("*").alias("n"), F.count_distinct("author").alias("authors"))


@register("SELECT 'commit' AS type, id, author, NULL AS state FROM {commits} UNION ALL SELECT 'pr', number, author, state FROM {pull_requests}")
def u4_tagged_union(commits, pull_requests):
    a = commits.select(F.lit("commit").alias("type"), "id", "author")
    return a.unionByName(pull_requests.select(F.lit("pr").alias("type"), F.col("number").alias("id"), "author", "state"), allowMissingColumns=True)


from weir import queries_code, queries_harvest, queries_history, queries_index, queries_planning, queries_queue, queries_reports, queries_text, queries_versions  # noqa: E402, F401  (they register their own)

__all__ = ["ORACLES", "QUERIES"]
