"""Queries for plans and reports: prior art, context, citations, status lines, discussions, loads and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weir.functions import redaction
from weir.functions import text as T
from weir.operators import activity as A
from weir.operators import planning as P
from weir.operators import search as Q
from weir.operators import work as K
from weir.queries_text import _JAC, _LOW
from weir.registry import register
from weir.sources import io
from weir.streaming import windows

NOW = 1704067200 + 27 * 86400
AS_OF = 893462400
_first = "CASE WHEN instr({0}, chr(10)) > 0 THEN string_split({0}, chr(10))[1] ELSE left({0}, 72) END"


@register(f"WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower({_first.format('content')}), '[a-z0-9]+')) AS w FROM {{plans}}), h AS (SELECT id, unnest(regexp_extract_all(lower({_first.format('content')}), '[a-z0-9]+')) AS w FROM {{ledger}}) SELECT DISTINCT id FROM h JOIN t USING (w) WHERE length(w) >= 4")
def j26_on_topic(plans, ledger):
    return P.on_topic(ledger.select("id", T.first_line(F.col("content")).alias("heading")), plans.select(T.first_line(F.col("content")).alias("topic")))


@register("SELECT i.id, max(s.name) AS session, (SELECT count(*) FROM {murmurs} m WHERE m.id % 4000 = i.id) AS murmurs FROM {work_items} i LEFT JOIN {sessions} s ON s.id = i.id AND NOT s.subagent GROUP BY 1")
def j28_evidence(work_items, sessions, murmurs):
    keys = murmurs.select(F.concat(F.lit("Mx"), (F.col("id") % 4000).cast("string")).alias("key"))
    return P.evidence(work_items, sessions.filter("not subagent"), keys)


@register(f"WITH r AS (SELECT l.id AS name, p.content IS NOT NULL AS there, list_distinct({_LOW.format('l.content')}) AS a, list_distinct({_LOW.format('p.content')}) AS b FROM {{ledger}} l LEFT JOIN {{plans}} p ON p.id = l.id) SELECT name, there, round(coalesce({_JAC.format('a', 'b')}, 0.0), 6) AS score FROM r")
def j33_compared(ledger, plans):
    return P.compared(ledger.select(F.col("id").alias("name"), F.col("content").alias("text")), plans.select(F.col("id").alias("name"), F.col("content").alias("text")))


_ITEMS = "SELECT author AS plan, topic AS kind, file AS ref, id, sec, least(1.0, value / 200) AS score FROM {murmurs}"


def items(murmurs):
    return murmurs.select(F.col("author").alias("plan"), F.col("topic").alias("kind"), F.col("file").alias("ref"), "id", "sec", F.least(F.lit(1.0), F.col("value") / 200).alias("score"))


@register(f"SELECT plan, id, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY score DESC, sec DESC, id) AS place FROM ({_ITEMS}) WHERE score >= 0.6) WHERE place <= 3")
def o9_prior_art(murmurs):
    return P.prior_art(items(murmurs))


@register(f"SELECT plan, kind, ref, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY score DESC, kind, ref) AS place FROM (SELECT plan, kind, ref, max(score) AS score FROM ({_ITEMS}) WHERE score >= 0.55 GROUP BY 1, 2, 3)) WHERE place <= 8")
def o12_bundle(murmurs):
    return P.bundle(items(murmurs), 8)


@register("SELECT author AS plan, count(*) FILTER (WHERE topic = 'error') AS collisions, count(*) FILTER (WHERE topic = 'view') AS prior_art, count(*) FILTER (WHERE topic = 'click') AS experts, count(DISTINCT file) AS files, count(DISTINCT CASE WHEN topic = 'signup' THEN id END) AS steps, count(*) FILTER (WHERE topic IN ('error', 'view', 'click')) > 0 AS material, count(DISTINCT file) >= 2 OR count(DISTINCT CASE WHEN topic = 'signup' THEN id END) >= 5 AS more FROM {murmurs} WHERE value < 9 GROUP BY 1")
def a32_signals(murmurs):
    kind = F.when(F.col("topic") == "error", "collision").when(F.col("topic") == "view", "prior-art").when(F.col("topic") == "click", "expert-route").otherwise("note")
    return P.signals(murmurs.filter("value < 9").select(F.col("author").alias("plan"), kind.alias("kind"), "file", F.when(F.col("topic") == "signup", F.col("id")).alias("step")))


_CORPORA = f"SELECT 'session' AS corpus, CAST(id AS VARCHAR) AS id, CASE WHEN id % 10 <> 0 THEN 1704067200 - id % 200 * 86400 END AS sec, lower(content) AS low FROM {{ledger}} UNION ALL SELECT 'murmur', CAST(id AS VARCHAR), sec, lower(topic || chr(10) || content) FROM {{murmurs}} UNION ALL SELECT 'plan', CAST(id AS VARCHAR), created_at, lower(content) FROM {{plans}}"


@register(f"WITH c AS ({_CORPORA}) SELECT corpus, id, sec, round(0.5 + least(0.5, (least(10, (length(low) - length(replace(low, 'er', ''))) // 2) + least(10, (length(low) - length(replace(low, 'r', ''))))) / 100), 6) AS score FROM c WHERE (sec IS NULL OR sec >= {NOW} - CASE corpus WHEN 'murmur' THEN 7 ELSE 90 END * 86400) AND contains(low, 'er') AND contains(low, 'r') ORDER BY score DESC, sec DESC NULLS LAST, corpus, id LIMIT 300")
def u3_f5_searched(ledger, murmurs, plans):
    at = F.when(F.col("id") % 10 != 0, F.lit(1704067200) - F.col("id") % 200 * 86400)
    corpora = {"session": ledger.select("id", at.alias("sec"), "content"), "murmur": murmurs.select("id", "sec", F.concat_ws("\n", "topic", "content").alias("content")), "plan": plans.select("id", F.col("created_at").alias("sec"), "content")}
    return P.searched(corpora, ["er", "r"], NOW, 300)


@register("""SELECT id, coalesce(nullif(env, ''), CASE WHEN kb = 'disabled' OR own = 'disabled' THEN 'disabled' END, nullif(own, ''), nullif(kb, ''), fallback) AS mode, coalesce(nullif(env, ''), nullif(kb, ''), nullif(own, ''), fallback) AS other FROM {settings}""")
def p30_effective(settings):
    layers = [F.col(c) for c in ("env", "kb", "own", "fallback")]
    return settings.select("id", P.effective(True, *layers).alias("mode"), P.effective(False, *layers).alias("other"))


PATTERNS = """[{"id": "limit", "reason": "rate_limited", "regex": "limit (reached|hit): [0-9]+", "substrings": ["limit"], "roles": ["system", "error"]},
    {"id": "quota", "reason": "quota_exceeded", "path": "k", "equals": "7"}, {"id": "any", "reason": "terminal_error", "regex": "hit: 9[0-9]", "roles": ["view"]}]"""


@register("SELECT id, pattern, CASE pattern WHEN 'quota' THEN 'quota_exceeded' WHEN 'limit' THEN 'rate_limited' ELSE 'terminal_error' END AS reason FROM (SELECT id, CASE WHEN json_extract_string(content, '$.k') = '7' THEN 'quota' WHEN topic = 'error' THEN 'limit' WHEN topic = 'view' AND regexp_matches(CAST(id AS VARCHAR), '^9[0-9]') THEN 'any' END AS pattern FROM {murmurs}) WHERE pattern IS NOT NULL")
def st2_x4_matched(murmurs):
    content = F.concat(F.lit("limit hit: "), F.col("id").cast("string"))
    rows = murmurs.select("id", P.first_match(P.load_patterns(PATTERNS), F.col("topic"), content, F.col("content")).alias("m"))
    return rows.filter("m is not null").select("id", "m.*")


@register("SELECT discussion, id, seconds, CAST(row_number() OVER (PARTITION BY discussion ORDER BY seconds, id) AS INTEGER) AS place FROM {keyframes} WHERE chapter = 'en'")
def r13_chapter(keyframes):
    return P.chapters(keyframes, "en")


@register("SELECT discussion, chapter, string_agg(DISTINCT nullif(content_type, ''), ',' ORDER BY nullif(content_type, '')) AS types FROM {keyframes} GROUP BY 1, 2")
def r13_visual_types(keyframes):
    return P.visual_types(keyframes, ["discussion", "chapter"])


@register("""WITH d AS (SELECT CASE WHEN min(id) % 2 = 0 THEN strftime(to_timestamp(1704067200 + min(id) * 3600) AT TIME ZONE 'UTC', '%Y-%m-%d') || '-' || discussion ELSE discussion END AS name, discussion AS title, min(id) AS id FROM {keyframes} GROUP BY discussion),
    t AS (SELECT discussion, string_agg(DISTINCT nullif(content_type, ''), ',' ORDER BY nullif(content_type, '')) AS types FROM {keyframes} GROUP BY 1), k AS (SELECT name, title, types, strftime(to_timestamp(1704067200 + id * 3600) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date FROM d LEFT JOIN t ON t.discussion = d.title)
    SELECT name, date, date || ' ' || title || coalesce(' [' || types || ']', '') || ' -- discussions/' || name || '/' AS line FROM k""")
def r11_discussion_index(keyframes):
    g = keyframes.groupBy("discussion").agg(F.min("id").alias("id")).withColumn("created", F.lit(1704067200) + F.col("id") * 3600)
    name = F.when(F.col("id") % 2 == 0, F.concat_ws("-", F.date_format(F.timestamp_seconds("created"), "yyyy-MM-dd"), "discussion")).otherwise(F.col("discussion"))
    named = g.select("discussion", name.alias("name"), "created")
    frames = keyframes.join(named.select("discussion", "name"), "discussion").drop("discussion").withColumnRenamed("name", "discussion")
    return P.discussion_index(named.select("name", F.col("discussion").alias("title"), "created"), frames)


@register("WITH s AS (SELECT author, string_agg(DISTINCT file, chr(0) ORDER BY file) || chr(0) AS all_, count(DISTINCT file) AS n FROM {murmurs} GROUP BY 1) SELECT author, 'N' || n || '-' || left(sha256(all_), 8) AS version, sha256(all_) AS hash FROM s")
def r32_identity(murmurs):
    return P.identity(murmurs, "author", "file")


_TYPED = "SELECT *, CASE id % 3 WHEN 0 THEN 'bug' WHEN 1 THEN 'feature' ELSE 'task' END AS type FROM {work_items}"


def typed(work_items):
    return work_items.withColumn("type", F.when(F.col("id") % 3 == 0, "bug").when(F.col("id") % 3 == 1, "feature").otherwise("task"))


@register(f"""WITH i AS ({_TYPED}), k AS (SELECT status, string_agg(n || ' ' || type || 's', ', ' ORDER BY type) AS parts FROM (SELECT status, type, count(*) AS n FROM i GROUP BY 1, 2) GROUP BY 1), g AS (SELECT status, count(*) || ' ' || status AS two, count(DISTINCT owner) || ' coworkers' AS who FROM i GROUP BY 1)
    SELECT status, two, array_to_string(string_split(two || ', ' || who, ' ')[1:4], ' ') AS four, array_to_string(string_split(two || ' by ' || who || ': ' || parts, ' ')[1:8], ' ') AS eight FROM g JOIN k USING (status)""")
def a39_status_lines(work_items):
    return P.status_lines(typed(work_items))


@register("WITH b AS (SELECT count(DISTINCT id) AS n FROM {work_items} JOIN {dependencies} ON issue_id = id WHERE status <> 'closed' AND type = 'blocks'), g AS (SELECT count(*) AS n, count(*) FILTER (WHERE status = 'closed') AS c, count(*) FILTER (WHERE status = 'in_progress') AS p, count(*) FILTER (WHERE status = 'open') AS o, count(DISTINCT owner) AS w FROM {work_items}) SELECT c || '/' || g.n || ' carts completed' || CASE WHEN p > 0 THEN ', ' || p || ' in progress' ELSE '' END || CASE WHEN o > 0 THEN ', ' || o || ' open' ELSE '' END || CASE WHEN w > 0 THEN ', ' || w || ' coworkers' ELSE '' END || CASE WHEN b.n > 0 THEN ', ' || b.n || ' blocked' ELSE '' END || '.' AS headline FROM g, b")
def a39_headline(work_items, dependencies):
    return P.headline(work_items, K.blockers(work_items, dependencies))


@register(f"SELECT k.by, k.value, count(*) AS n, count(*) FILTER (WHERE status = 'closed') AS closed, round(count(*) FILTER (WHERE status = 'closed') / count(*), 6) AS rate FROM ({_TYPED}) i, LATERAL (SELECT unnest(['status', 'type']) AS by, unnest([i.status, i.type]) AS value) k GROUP BY 1, 2")
def a19_by_status_and_type(work_items):
    own = typed(work_items)
    side = lambda by: K.progress(own, by).select(F.lit(by).alias("by"), F.col(by).alias("value"), "n", "closed", "rate")
    return side("status").unionByName(side("type"))


_TRIAGE = "SELECT p.number, created_at, greatest(coalesce(updated_at, 0), coalesce(c.last, 0)) AS last_activity, coalesce(c.n, 0) AS comments FROM {pull_requests} p LEFT JOIN (SELECT pr_id, count(*) AS n, max(created_at) AS last FROM {pr_comments} GROUP BY 1) c ON c.pr_id = p.id WHERE state = 'open'"


@register(f"WITH t AS ({_TRIAGE}) " + " UNION ALL ".join(f"(SELECT '{k}' AS by, number, created_at, last_activity, comments, CAST(row_number() OVER (ORDER BY {o}) AS INTEGER) AS place FROM t QUALIFY place <= 40)" for k, o in (("stalled", "last_activity, number"), ("age", "created_at, number"), ("activity", "comments DESC, last_activity DESC, number"))))
def o3_triage_orders(pull_requests, pr_comments):
    return A.triaged(pull_requests, pr_comments, 40)


@register("SELECT number, state, coalesce(merged_at, updated_at, created_at) AS at FROM {pull_requests} WHERE state <> 'open' ORDER BY coalesce(merged_at, updated_at, created_at) DESC, number LIMIT 120")
def o10_newest_activity(pull_requests):
    return pull_requests.filter("state <> 'open'").select("number", "state", F.coalesce("merged_at", "updated_at", "created_at").alias("at")).orderBy(F.desc("at"), "number").limit(120)


@register("SELECT c.commit_id, path, o.language AS old_language, n.language AS new_language, o.id AS old_id, n.id AS new_id FROM {blob_changes} c LEFT JOIN {blobs} o ON o.id = c.old_blob_id LEFT JOIN {blobs} n ON n.id = c.new_blob_id")
def j7_old_and_new(blob_changes, blobs):
    return A.with_blobs(blob_changes, blobs)


@register("SELECT CAST(CAST(to_timestamp(t) AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) AS day, type, count(*) AS n FROM (SELECT 'pr' AS type, coalesce(merged_at, updated_at) AS t FROM {pull_requests} UNION ALL SELECT 'issue', updated_at FROM {issues} UNION ALL SELECT 'commit', timestamp FROM {commits}) GROUP BY 1, 2")
def a11_by_day(pull_requests, issues, commits):
    return A.by_day(pull_requests, commits, issues)


@register("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT author) AS authors, min(sec) AS first FROM {murmurs} GROUP BY 1")
def a33_by_day(murmurs):
    return murmurs.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("author").alias("authors"), F.min("sec").alias("first"))


@register("SELECT type, count(*) AS n, CAST(sum(strlen(content)) AS BIGINT) AS before, CAST(sum(strlen(regexp_replace(trim(content), '[ \\t\\r\\n]+', ' ', 'g'))) AS BIGINT) AS after, round(CASE WHEN sum(strlen(content)) > 0 THEN 100 * (sum(strlen(content)) - sum(strlen(regexp_replace(trim(content), '[ \\t\\r\\n]+', ' ', 'g')))) / sum(strlen(content)) ELSE 0.0 END, 6) AS saved FROM {transcript} GROUP BY 1")
def a30_reduction(transcript):
    """What squeezing white space saves, in bytes and percent."""
    small = F.regexp_replace(F.trim("content"), r"[ \t\r\n]+", " ")
    g = transcript.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("before"), F.sum(F.octet_length(small)).alias("after"))
    return g.withColumn("saved", F.round(F.when(F.col("before") > 0, 100 * (F.col("before") - F.col("after")) / F.col("before")).otherwise(0.0), 6))


@register("WITH n AS (SELECT *, lead(sec) OVER (PARTITION BY author ORDER BY sec, id) - sec AS wait FROM {murmurs}) SELECT author, importance, count(*) AS hits, count(*) FILTER (WHERE wait IS NULL OR wait >= 3600) AS confirmed, count(*) FILTER (WHERE wait < 3600) AS revoked FROM n WHERE topic = 'click' GROUP BY 1, 2")
def a25_counters(murmurs):
    return P.outcomes(murmurs, "click", 3600)


_CITES = "SELECT document AS doc, CAST(row_number() OVER (PARTITION BY document ORDER BY seen, host) AS BIGINT) AS num, '[' || host || '] p' || seen AS label, CASE WHEN seen % 3 > 0 THEN label ELSE '' END AS url, CASE WHEN seen % 3 > 0 THEN label WHEN seen % 2 = 0 THEN 'pages/' || seen ELSE 'label:[' || host || '] p' || seen END AS key FROM {links}"


def cites(links):
    seen, label = F.col("seen"), F.concat(F.lit("["), "host", F.lit("] p"), F.col("seen").cast("string"))
    num = F.row_number().over(W.partitionBy("document").orderBy("seen", "host")).cast("long")
    key = F.when(seen % 3 > 0, F.col("label")).when(seen % 2 == 0, F.concat(F.lit("pages/"), seen.cast("string"))).otherwise(F.concat(F.lit("label:"), label))
    return links.select(F.col("document").alias("doc"), num.alias("num"), label.alias("label"), F.when(seen % 3 > 0, F.col("label")).otherwise("").alias("url"), key.alias("key"))


@register(_CITES)
def r12_sources(links):
    """Sources sections, written and read again."""
    return P.parsed_sources(P.rendered_sources(cites(links)))


_INPUTS = "SELECT id % 40 AS doc, id // 40 % 5 AS input, CAST(row_number() OVER (PARTITION BY id % 40, id // 40 % 5 ORDER BY id) AS BIGINT) AS num, topic || (id % 9) AS label, CASE WHEN value > 60 THEN 'u/' || file ELSE '' END AS url, CASE WHEN value > 60 THEN 'u/' || file ELSE 'label:' || topic || (id % 9) END AS key FROM {murmurs} WHERE id % 6 = 0"


@register(f"""WITH r AS ({_INPUTS}), f AS (SELECT doc, key, min((input, num)) AS pos, arg_min(label, (input, num)) AS label, arg_min(url, (input, num)) AS url FROM r GROUP BY 1, 2), b AS (SELECT doc, label, key AS bare, pos AS since FROM f WHERE url = ''),
    t AS (SELECT f.doc, bare, arg_min(f.key, f.pos) AS key, arg_min(f.url, f.pos) AS url FROM f JOIN b ON b.doc = f.doc AND b.label = f.label WHERE f.url <> '' AND f.pos > since GROUP BY 1, 2), l AS (SELECT f.*, row_number() OVER (PARTITION BY f.doc ORDER BY pos) AS number FROM f LEFT JOIN t ON t.doc = f.doc AND t.key = f.key WHERE t.key IS NULL),
    k AS (SELECT l.doc, l.key, number, coalesce(t.url, l.url) AS link FROM l LEFT JOIN t ON t.doc = l.doc AND t.bare = l.key UNION ALL SELECT t.doc, t.key, number, t.url FROM t JOIN l ON l.doc = t.doc AND l.key = t.bare) SELECT r.doc, input, num, CAST(number AS INTEGER) AS number, link FROM r JOIN k ON k.doc = r.doc AND k.key = r.key""")
def a35_merged_citations(murmurs):
    doc, part, label = F.col("id") % 40, F.floor(F.col("id") / 40) % 5, F.concat("topic", (F.col("id") % 9).cast("string"))
    url = F.when(F.col("value") > 60, F.concat(F.lit("u/"), "file")).otherwise("")
    own = murmurs.filter("id % 6 = 0").select("id", doc.alias("doc"), part.alias("input"), label.alias("label"), url.alias("url"))
    num = F.row_number().over(W.partitionBy("doc", "input").orderBy("id")).cast("long")
    return P.merged_citations(own.select("doc", "input", num.alias("num"), "label", "url", F.col("url").alias("key")))


@register(r"""SELECT id, 'see [' || (id % 6 + 10) || '] and `x[1]` then [9]' || chr(10) || '```' || chr(10) || '[1]' || chr(10) || '```[' || CASE WHEN id % 2 = 0 THEN '20' ELSE '8' END || ']' AS text FROM {murmurs}""")
def r12_renumbered(murmurs):
    k = F.col("id") % 6
    text = F.concat(F.lit("see ["), k.cast("string"), F.lit("] and `x[1]` then [9]\n```\n[1]\n```["), F.when(F.col("id") % 2 == 0, "7").otherwise("8"), F.lit("]"))
    numbers = F.map_from_arrays(F.array(k.cast("string"), F.lit("7")), F.array((k + 10).cast("string"), F.lit("20")))
    return murmurs.select("id", P.renumbered(text, numbers).alias("text"))


_SAID = r"trim(regexp_replace(content, '[\s<>&\-]+', ' ', 'g'))"


@register(f"SELECT session, seq, CASE WHEN type = 'system' THEN '' ELSE type END AS speaker, {_SAID} AS said FROM {{transcript}} WHERE {_SAID} <> ''")
def src14_cues(transcript):
    """Transcripts as WebVTT, read again."""
    return P.cues(captions(transcript)).select(F.col("doc").alias("session"), (F.col("n") - 1).cast("long").alias("seq"), "speaker", "said")


def captions(transcript):
    said = F.trim(F.regexp_replace("content", r"[\s<>&\-]+", " "))
    voice = F.when(F.col("type") == "system", said).otherwise(F.concat(F.lit("<v "), "type", F.lit(">"), said, F.lit("</v>")))
    block = F.concat(F.col("seq").cast("string"), F.lit("\r\n00:00:01.000 --> 00:00:02.000\r\n"), voice)
    g = transcript.filter(said != "").groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", block.alias("b")))).alias("all"))
    return g.select(F.col("session").alias("doc"), F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("all", lambda x: x["b"]), "\n\n")).alias("text"))


@register(f"WITH c AS (SELECT session, seq, CASE WHEN type = 'system' THEN '' ELSE type END AS speaker, {_SAID} AS said FROM {{transcript}} WHERE {_SAID} <> ''), s AS (SELECT *, CASE WHEN speaker = '' OR speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY session ORDER BY seq) THEN 1 ELSE 0 END AS start FROM c), t AS (SELECT *, sum(start) OVER (PARTITION BY session ORDER BY seq) AS turn FROM s), l AS (SELECT session, turn, CASE WHEN speaker <> '' THEN speaker || ': ' ELSE '' END || string_agg(said, ' ' ORDER BY seq) AS line FROM t GROUP BY session, turn, speaker) SELECT session AS doc, string_agg(line, chr(10) ORDER BY turn) AS text FROM l GROUP BY 1")
def src14_spoken(transcript):
    return P.spoken(P.cues(captions(transcript)))


@register("""WITH n AS (SELECT DISTINCT unnest(['daily/' || date || '-' || team || '.md', 'weekly/' || strftime(CAST(date AS DATE), '%G-W%V') || '.md', 'monthly/' || left(date, 7) || '.md', 'weekly/2023-W53.md', 'notes/' || date || '.txt']) AS name FROM {history})
    SELECT name, layer, "start", "end" FROM (SELECT name, 'daily' AS layer, CAST(regexp_extract(name, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS DATE) AS "start", CAST(regexp_extract(name, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS DATE) + 1 AS "end" FROM n WHERE starts_with(name, 'daily/') UNION ALL
    SELECT name, 'weekly', CAST(strptime(substr(name, 8, 8) || '-1', '%G-W%V-%u') AS DATE), CAST(strptime(substr(name, 8, 8) || '-1', '%G-W%V-%u') AS DATE) + 7 FROM n WHERE starts_with(name, 'weekly/') AND name <> 'weekly/2023-W53.md' UNION ALL SELECT name, 'monthly', CAST(substr(name, 9, 7) || '-01' AS DATE), CAST(CAST(substr(name, 9, 7) || '-01' AS DATE) + INTERVAL 1 MONTH AS DATE) FROM n WHERE starts_with(name, 'monthly/'))
    WHERE "start" < DATE '2024-01-20' AND "end" > DATE '2024-01-08'""")
def src15_dated(history):
    d = F.to_date("date")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    names = F.array(F.concat(F.lit("daily/"), "date", F.lit("-"), "team", F.lit(".md")), F.concat(F.lit("weekly/"), week, F.lit(".md")), F.concat(F.lit("monthly/"), F.substring("date", 1, 7), F.lit(".md")), F.lit("weekly/2023-W53.md"), F.concat(F.lit("notes/"), "date", F.lit(".txt")))
    return P.dated(history.select(F.explode(names).alias("name")).distinct(), "2024-01-08", "2024-01-20")


@register("SELECT id, author, value FROM (SELECT CASE WHEN id % 10 <> 4 THEN id END AS id, CASE WHEN id % 10 <> 4 THEN author END AS author, CASE WHEN id % 10 <> 4 THEN value END AS value, id AS k FROM {murmurs}) WHERE k % 10 <> 3")
def src13_src16_parsed(murmurs):
    """Lines of JSON, every tenth broken and every tenth without a field that is known."""
    line = F.when(F.col("id") % 10 == 3, '{"id": ').when(F.col("id") % 10 == 4, '{"other": 1}').otherwise(F.to_json(F.struct("id", "author", "value")))
    return io.parsed(murmurs.select(line.alias("value")), "id long, author string, value double")


@register("SELECT file AS path, sec AS mtime FROM {murmurs} m WHERE NOT EXISTS (SELECT 1 FROM {murmurs} s WHERE s.id % 2 = 0 AND s.file = m.file AND s.sec = m.sec)")
def src5_changed(murmurs):
    files = murmurs.select(F.col("file").alias("path"), F.col("sec").alias("mtime"), "id")
    return io.changed(files.drop("id"), files.filter("id % 2 = 0").drop("id"))


@register("SELECT file, sec, author FROM {murmurs} WHERE id % 3 = 0 AND topic = 'click' UNION ALL SELECT file, arg_min(sec, (sec, id)), arg_min(author, (sec, id)) FROM {murmurs} WHERE topic = 'view' AND file NOT IN (SELECT file FROM {murmurs} WHERE id % 3 = 0 AND topic = 'click') GROUP BY 1")
def snk2_inserted(murmurs):
    cols = ["file", "sec", "author"]
    return io.insert_or_ignore(murmurs.filter("id % 3 = 0 and topic = 'click'").select(*cols), murmurs.filter("topic = 'view'").select(*cols, "id"), ["file"], ["sec", "id"])


@register("WITH n AS (SELECT file, max((sec, id)) AS pos, arg_max(author, (sec, id)) AS author FROM {murmurs} WHERE topic = 'view' GROUP BY 1) SELECT file, sec, author FROM {murmurs} WHERE topic = 'click' AND file NOT IN (SELECT file FROM n) UNION ALL SELECT file, pos[1], author FROM n")
def snk3_upserted(murmurs):
    cols = ["file", "sec", "author"]
    return io.upsert(murmurs.filter("topic = 'click'").select(*cols), io.latest(murmurs.filter("topic = 'view'"), ["file"], ["sec", "id"]), ["file"])


@register("SELECT strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y/%m/%d') AS dir, number, left(sha256(number || '|' || title || '|' || state), 8) AS hash FROM {pull_requests} WHERE number % 3 <> 0 OR state <> 'merged'")
def r24_new_snapshots(pull_requests):
    """Snapshots to write: those whose content isn't stored yet; every third request is stored as merged."""
    stored = io.snapshots(pull_requests.filter("number % 3 = 0").withColumn("state", F.lit("merged")), ["number", "title", "state"])
    return io.new_snapshots(io.snapshots(pull_requests, ["number", "title", "state"]), stored)


@register("SELECT strftime(time_bucket(INTERVAL 10 MINUTES, ts), '%Y-%m-%d %H:%M:%S') AS start, topic, count(*) AS n FROM {murmurs} GROUP BY 1, 2")
def st4_tumbling(murmurs):
    return windows.tumbling(murmurs).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@register("SELECT DISTINCT id, author FROM {murmurs} WHERE author <> 'u3'")
def st8_relayed(murmurs):
    return windows.relayed(murmurs.select("id", "author", "ts").unionByName(murmurs.filter("id % 4 = 0").select("id", "author", "ts")), "u3").select("id", "author")


_SPANS = "SELECT author AS trace, id AS span, sec, topic = 'purchase' AS root FROM {murmurs}"


@register(f"WITH s AS ({_SPANS}), r AS (SELECT trace, min((sec, span)) AS r FROM s WHERE root GROUP BY 1) SELECT s.trace, min(r[2]) AS root, count(*) FILTER (WHERE (sec, span) <= r) AS spans, count(*) FILTER (WHERE (sec, span) > r AND sec <= r[1] + 7200) AS dropped, count(*) FILTER (WHERE sec > r[1] + 7200) AS waiting FROM s JOIN r ON r.trace = s.trace GROUP BY 1")
def st6_assembled(murmurs):
    return P.assembled(murmurs.select(F.col("author").alias("trace"), F.col("id").alias("span"), "sec", (F.col("topic") == "purchase").alias("root")), 7200)


@register("SELECT id, array_to_string(list_filter(['fix', CAST(id % 50 AS VARCHAR), replace(left(title, 8), ' ', '_')], lambda x: strlen(x) >= 2), ',') AS terms FROM {pull_requests}")
def f7_search_terms(pull_requests):
    text = F.concat(F.lit('+fix AND "bug:'), (F.col("id") % 50).cast("string"), F.lit('" NOT '), F.regexp_replace(F.substring("title", 1, 8), " ", "_"), F.lit(" (-) OR"))
    return Q.search_terms(pull_requests.select("id", text.alias("text"))).withColumn("terms", F.array_join("terms", ","))


def _redacting(sql):
    for words, pattern, slug in redaction.CATALOGUE:
        quoted = pattern.replace("'", "''")
        new = f"regexp_replace(c, '{quoted}', '{slug}', 'g')"
        has = " OR ".join(f"contains(l, '{w}')" for w in words.split(",") if w)
        sql = f"SELECT id, l, {f'CASE WHEN {has} THEN {new} ELSE c END' if has else new} AS c FROM ({sql})"
    return sql


@register("SELECT id, c AS redacted FROM (" + _redacting("SELECT id, lower(content) AS l, content AS c FROM {ledger}") + ")")
def redaction_catalogue(ledger):
    return redaction.redacted(ledger.select("id", F.col("content").alias("redacted")), "redacted")
