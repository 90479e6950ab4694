"""Queries on recorded sessions, their tool calls, and murmurs of a window."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.operators import collaboration as C
from weir.operators import harvest as V
from weir.operators import sessions as S
from weir.registry import register

NOW = 1704067200 + 20 * 86400
THEN = 893462400  # 1998-04-25
SINCE, UNTIL = THEN - 60 * 86400, THEN + 60 * 86400
_FILE = r"""CASE WHEN instr(p, '/internal/') > 0 THEN substr(p, instr(p, '/internal/') + 1) WHEN instr(p, '/pkg/') > 0 THEN substr(p, instr(p, '/pkg/') + 1) ELSE regexp_extract(p, '[^/]*/[^/]*$') END"""
_EDITED = f"SELECT session, list_sort(list(DISTINCT {_FILE})) AS files FROM (SELECT session, coalesce(json_extract_string(input, '$.file_path'), json_extract_string(input, '$.path')) AS p FROM {{tool_calls}} WHERE lower(tool) IN ('edit', 'write', 'multiedit')) GROUP BY 1"
_LISTED = f"SELECT * FROM {{sessions}} WHERE created_at >= {SINCE} AND NOT (recording AND NOT has_raw AND created_at < {THEN - 48 * 3600})"
_HARVESTED = f"""WITH e AS ({_EDITED}), l AS ({_LISTED}), s AS (SELECT session AS id, list_sort(list(DISTINCT {_FILE})) AS files FROM (SELECT session, coalesce(json_extract_string(input, '$.file_path'), json_extract_string(input, '$.path')) AS p FROM {{tool_calls}} WHERE seq <= 2 AND session % 2 = 0) GROUP BY 1)
    SELECT l.id, name, l.user, created_at, CASE WHEN l.id % 6 = 0 AND s.id IS NOT NULL THEN 'summary of ' || l.id ELSE title END AS title, CASE WHEN s.id IS NOT NULL THEN 'told' END AS summary, array_to_string(coalesce(s.files, e.files, []), ',') AS files, recording
    FROM l LEFT JOIN s ON s.id = l.id LEFT JOIN e ON e.session = l.id WHERE created_at <= {UNTIL} AND NOT subagent"""
_joined = lambda df: df.withColumn("files", F.array_join("files", ","))


def summaries(tool_calls):
    """Every second session has one; it names the files of its first two calls."""
    path = F.coalesce(F.get_json_object("input", "$.file_path"), F.get_json_object("input", "$.path"))
    g = tool_calls.filter("seq <= 2 and session % 2 = 0").groupBy("session").agg(F.array_sort(F.collect_set(V.relative(path))).alias("files"))
    title = F.when(F.col("session") % 6 == 0, F.concat(F.lit("summary of "), F.col("session").cast("string"))).otherwise("")
    return g.select(F.col("session").alias("id"), title.alias("title"), F.lit("told").alias("summary"), "files")


def harvest(sessions, tool_calls):
    return V.harvested(sessions, tool_calls, summaries(tool_calls), SINCE, UNTIL, THEN)


@register(f"SELECT id, author, topic, sec FROM {{murmurs}} WHERE sec BETWEEN {NOW - 7 * 86400} AND {NOW}")
def src6_murmurs_in_window(murmurs):
    return V.in_window(murmurs, NOW - 7 * 86400, NOW).select("id", "author", "topic", "sec")


@register(f"SELECT id, author, topic, sec FROM {{murmurs}} WHERE sec BETWEEN {NOW - 86400} AND {NOW}")
def src7_murmurs_of_a_day(murmurs):
    return V.last_hours(murmurs, NOW, 72).select("id", "author", "topic", "sec")


@register(_HARVESTED)
def src8_harvested(sessions, tool_calls):
    return _joined(harvest(sessions, tool_calls))


@register(f"SELECT session, array_to_string(files, ',') AS files FROM ({_EDITED})")
def src9_edited_files(tool_calls):
    return _joined(V.edited_files(tool_calls))


@register(f"SELECT id, name, created_at FROM ({_LISTED}) ORDER BY created_at DESC, id DESC")
def src10_listed(sessions):
    return V.listed(sessions, SINCE, THEN).select("id", "name", "created_at").orderBy(F.desc("created_at"), F.desc("id"))


@register("WITH a AS (SELECT DISTINCT asked FROM (SELECT 'Ox' || (session * 2) AS asked FROM {tool_calls} UNION ALL SELECT name FROM {sessions} WHERE id % 50 = 0)), k AS (SELECT asked, count(s.name) AS n, min(s.name) AS whole, bool_or(s.name = asked) AS exact FROM a LEFT JOIN (SELECT name, regexp_extract(name, '[^-]*$') AS last FROM {sessions}) s ON s.name = asked OR s.last = asked GROUP BY 1) SELECT asked, CASE WHEN exact OR n = 0 THEN asked WHEN n = 1 THEN whole END AS name, CAST(CASE WHEN exact THEN 1 ELSE n END AS BIGINT) AS found FROM k")
def src11_resolved(sessions, tool_calls):
    ids = tool_calls.select(F.concat(F.lit("Ox"), (F.col("session") * 2).cast("string")).alias("asked"))  # every second one is too high
    return V.resolved(sessions, ids.unionByName(sessions.filter("id % 50 = 0").select(F.col("name").alias("asked"))).distinct())


@register(f"""WITH h AS ({_HARVESTED.replace("array_to_string(coalesce(s.files, e.files, []), ',') AS files", "coalesce(s.files, e.files, []) AS files")}), f AS (SELECT name, l.user AS author, unnest(files) AS file FROM h l), m AS (SELECT author, file FROM f UNION ALL SELECT 'c' || substr(author, 2), regexp_replace(file, '^pkg([0-9]+)/d([0-9]+)/f[0-9]+$', 'internal/p\\1\\2.go') FROM {{murmurs}})
    SELECT file, string_agg(DISTINCT author, ',' ORDER BY author) AS authors, count(DISTINCT author) AS n_authors FROM m GROUP BY 1 HAVING count(DISTINCT author) >= 2""".replace("\\\\", "\\"))
def u5_conflicts_with_sessions(sessions, tool_calls, murmurs):
    """Conflicts over murmurs and harvested sessions together."""
    path = F.regexp_replace("file", r"^pkg([0-9]+)/d([0-9]+)/f[0-9]+$", "internal/p$1$2.go")
    own = murmurs.select(F.concat(F.lit("c"), F.substr("author", F.lit(2))).alias("author"), path.alias("file"))
    return C.conflicts(V.as_murmurs(harvest(sessions, tool_calls)).select("author", "file").unionByName(own))


@register("SELECT id, CASE WHEN score < 0.3 THEN 'discard' WHEN score < 0.6 THEN 'local_only' ELSE 'upload' END AS by_score, CASE category WHEN 'skip' THEN 'discard' WHEN 'local_only' THEN 'local_only' ELSE 'upload' END AS by_category FROM {sessions}")
def p26_dispositions(sessions):
    return sessions.select("id", V.disposition(F.col("score"), 0.6, 0.3).alias("by_score"), V.category_disposition(F.col("category")).alias("by_category"))


@register("SELECT id, CASE WHEN NOT recording THEN CASE WHEN stop_reason = 'canceled' THEN 'canceled' WHEN uploaded THEN 'uploaded' WHEN stop_reason = 'stopped' THEN 'paused' ELSE 'local' END WHEN NOT alive THEN CASE WHEN has_raw OR entries > 0 THEN 'orphan' ELSE 'ghost' END WHEN suspended THEN 'suspended' ELSE 'recording' END AS status FROM {sessions}")
def p27_status(sessions):
    return sessions.select("id", V.status(sessions).alias("status"))


@register("SELECT id, path FROM (SELECT id, CASE id % 5 WHEN 0 THEN '../' || file WHEN 1 THEN '.cursor/' || file WHEN 2 THEN file || '.go.tmp.' || id ELSE file END AS path FROM {murmurs}) WHERE id % 5 > 2")
def p29_without_noise(murmurs):
    k = F.col("id") % 5
    path = F.when(k == 0, F.concat(F.lit("../"), "file")).when(k == 1, F.concat(F.lit(".cursor/"), "file")).when(k == 2, F.concat("file", F.lit(".go.tmp."), F.col("id").cast("string"))).otherwise(F.col("file"))
    rows = murmurs.select("id", path.alias("path"))
    return rows.filter(~V.is_noise(F.col("path")))


@register(f"SELECT id, name FROM {{sessions}} WHERE created_at >= {THEN - 90 * 86400}")
def r21_pruned(sessions):
    return V.pruned(sessions, THEN, 90).select("id", "name")


@register(f"SELECT session, seq FROM (SELECT session, seq, CASE WHEN seq <> 3 THEN sec END AS sec FROM {{tool_calls}}) WHERE sec IS NULL OR sec >= {THEN}")
def r15_from_start(tool_calls):
    return V.from_start(tool_calls.withColumn("sec", F.when(F.col("seq") != 3, F.col("sec"))), THEN).select("session", "seq")


@register("SELECT session, type, count(*) AS n, min(seq) AS first FROM {transcript} WHERE type IN ('user', 'system') GROUP BY 1, 2")
def r16_by_type(transcript):
    return transcript.filter(F.col("type").isin("user", "system")).groupBy("session", "type").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


@register("SELECT id, CASE id % 4 WHEN 0 THEN 'final' WHEN 1 THEN 'implementation' WHEN 3 THEN 'plan' END AS marker, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS diagrams FROM {ledger} WHERE content IS NOT NULL")
def r17_plan_markers(ledger):
    k = F.col("id") % 4
    head = F.when(k == 0, "## Final plan").when(k == 1, "##  Implementation Plan for it").when(k == 2, "## Planning").otherwise("## plan")
    block = F.when(F.col("id") % 3 == 0, F.lit("\n```mermaid\ngraph LR\n```\n")).otherwise(F.lit("\n```mermaid open\n"))
    text = F.concat(F.regexp_replace("content", "[`#]", " "), F.lit("\n"), head, block)
    return ledger.filter("content is not null").select("id", V.plan_marker(text).alias("marker"), F.size(V.diagrams(text)).alias("diagrams"))


@register("WITH n AS (SELECT *, greatest(0, coalesce(lead(sec) OVER (PARTITION BY session ORDER BY seq, sec) - sec, 0)) AS took FROM {tool_calls}) SELECT session, count(*) AS n, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(took) AS BIGINT) AS took FROM n WHERE tool = 'Task' GROUP BY 1")
def r18_task_calls(tool_calls):
    return V.task_calls(tool_calls)


_KIND = "CASE topic WHEN 'purchase' THEN 'user' WHEN 'signup' THEN 'assistant' WHEN 'click' THEN 'edit' ELSE topic END"


@register(f"""WITH e AS (SELECT author, sec, id, {_KIND} AS kind, value > 200 AS failed FROM {{murmurs}}), w AS (SELECT *, kind NOT IN ('user', 'assistant') AS work FROM e), s AS (SELECT *, CASE WHEN work AND NOT coalesce(lag(work) OVER (PARTITION BY author ORDER BY sec, id), false) THEN 1 ELSE 0 END AS start FROM w),
    b AS (SELECT *, CAST(sum(start) OVER (PARTITION BY author ORDER BY sec, id) AS BIGINT) AS block FROM s), g AS (SELECT author, block, kind, count(*) AS n, count(*) FILTER (WHERE failed) AS failed, min(sec) AS first, max(sec) AS last FROM b WHERE work GROUP BY 1, 2, 3)
    SELECT author, block, CAST(sum(n) AS BIGINT) AS n, string_agg(kind || ':' || n, ',' ORDER BY kind) AS tools, CAST(sum(failed) AS BIGINT) AS failed, bool_or(kind = 'edit') AS edits, min(first) AS first, max(last) AS last FROM g GROUP BY 1, 2""")
def a27_tool_blocks(murmurs):
    kind = F.when(F.col("topic") == "purchase", "user").when(F.col("topic") == "signup", "assistant").when(F.col("topic") == "click", "edit").otherwise(F.col("topic"))
    return V.tool_blocks(murmurs.select("author", "sec", "id", kind.alias("kind"), (F.col("value") > 200).alias("failed")))


@register(r"""WITH t AS (SELECT session, seq, type, trim(coalesce(content, '')) AS said FROM {transcript}), g AS (SELECT session, count(*) FILTER (WHERE type = 'user') AS u, count(*) FILTER (WHERE type = 'assistant') AS a, count(*) FILTER (WHERE type = 'tool') AS k, arg_min(said, seq) FILTER (WHERE type = 'user' AND said <> '' AND NOT starts_with(said, '/')) AS ask FROM t GROUP BY 1),
    l AS (SELECT *, list_filter(list_transform(string_split(ask, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#'))[1] AS line FROM g) SELECT session, coalesce(left(line, 120) || chr(10) || chr(10), '') || u || ' user messages, ' || a || ' assistant responses' || CASE WHEN k > 0 THEN '. ' || k || ' tool calls' ELSE '' END AS summary FROM l""")
def r19_local_summaries(transcript):
    return V.local_summary(transcript)


@register("""SELECT id, CASE WHEN category = 'skip' THEN NULL WHEN strlen(trim(title)) < 3 THEN 'title too short' WHEN strlen(trim(title)) > 200 THEN 'title too long' WHEN strlen(s) < 20 THEN 'summary too short' WHEN stop_reason NOT IN ('stopped', 'recovered') THEN 'no outcome' WHEN n > 20 AND strlen(s) < 80 THEN 'summary not rich' WHEN n > 20 AND id % 5 < 3 THEN 'few actions' WHEN n > 50 AND id % 7 = 0 THEN 'no moments' END AS flaw
    FROM (SELECT *, entries * 3 AS n, trim(repeat(title || ' ', CAST(id % 9 AS INTEGER))) AS s FROM {sessions})""")
def r20_flaws(sessions):
    outcome = F.when(F.col("stop_reason") == "stopped", "success").when(F.col("stop_reason") == "recovered", "partial").otherwise("")
    summary = F.repeat(F.concat("title", F.lit(" ")), (F.col("id") % 9).cast("int"))
    return sessions.select("id", V.flaws(F.col("title"), summary, outcome, F.col("category"), F.col("id") % 5, F.col("id") % 7, F.col("entries") * 3).alias("flaw"))


@register(f"SELECT id, max(sec) AS last, count(*) AS n FROM (SELECT author AS id, sec FROM {{murmurs}} WHERE sec >= {NOW - 86400} AND sec <= {NOW}) GROUP BY 1")
def r22_latest_of_agents(murmurs):
    return V.last_hours(murmurs, NOW, 24).groupBy(F.col("author").alias("id")).agg(F.max("sec").alias("last"), F.count("*").alias("n"))


_RECALL = r"(?i)\b(find|recall|how\s+did\s+we|how\s+do\s+we|has\s+anyone|what\s+is|what\s+are|explain|where\s+is|why\s+does|why\s+did|when\s+did|who\s+(wrote|owns|added|changed)|search\s+for|look\s+up)\b"
_LEADS = "['Find the', 'Fix: where is', 'What is', 'add', 'how did we', 'Explain why', 'note']"


@register(rf"SELECT session, seq FROM (SELECT session, seq, trim({_LEADS}[CAST(seq % 7 + 1 AS INTEGER)] || ' ' || content) AS t FROM {{transcript}}) WHERE length(t) >= 20 AND lower(regexp_replace(regexp_extract(t, '^[^ \t\n]+'), '[,.;:!?]+$', '')) NOT IN ({', '.join(repr(v) for v in V.ACTION_VERBS)}) AND regexp_matches(t, '{_RECALL}')")
def p24_recall_intent(transcript):
    leads = F.array(*map(F.lit, ("Find the", "Fix: where is", "What is", "add", "how did we", "Explain why", "note")))
    text = F.concat_ws(" ", F.element_at(leads, (F.col("seq") % 7 + 1).cast("int")), F.col("content"))
    return transcript.filter("content is not null").withColumn("t", text).filter(V.asks_for_recall(F.col("t"))).select("session", "seq")


@register("SELECT session, seq, first_seq FROM (SELECT session, seq, min(seq) OVER (PARTITION BY session, file) AS first_seq FROM (SELECT author AS session, id AS seq, file FROM {murmurs})) WHERE seq > first_seq")
def w9_repeats(murmurs):
    return S.repeats(murmurs.select(F.col("author").alias("session"), F.col("id").alias("seq"), F.col("file").alias("content")))


@register("WITH c AS (SELECT *, CAST(sum(CASE WHEN type = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS BIGINT) AS chapter FROM {transcript}), g AS (SELECT session, chapter, type, count(*) AS n, min(seq) AS first, max(seq) AS last FROM c GROUP BY 1, 2, 3) SELECT session, chapter, min(first) AS first, max(last) AS last, string_agg(type || ':' || n, ',' ORDER BY type) AS tools FROM g GROUP BY 1, 2")
def a28_chapter_tools(transcript):
    return S.chapter_tools(transcript)
