"""Queries on the message bus and the task queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.operators import queue as U
from weir.registry import register

NOW = 1704067200 + 20 * 86400
THEN = 893462400  # 1998-04-25, inside the tasks' times
AGENTS = ["building", "machinery"]
_RANK = "CASE importance WHEN 'critical' THEN 0 WHEN 'normal' THEN 1 WHEN 'ambient' THEN 2 ELSE 3 END"
_CURSORS = f"SELECT author AS reader, max(sec) AS last_seen FROM {{murmurs}} WHERE topic = 'purchase' AND sec < {NOW} AND author IN ('u3', 'u7', 'u11') GROUP BY 1"
_LAPSED = f"status = 'in_progress' AND ((lease_expires_at <> 0 AND lease_expires_at < {THEN}) OR (claimed_host = 'h1' AND NOT alive))"
_QUEUE = f"""SELECT * FROM (SELECT id, priority, CASE WHEN {_LAPSED} THEN 'ready' ELSE status END AS status, target_agent, dedup_key, created_at, expires_at, CASE WHEN {_LAPSED} THEN '' ELSE claimed_host END AS claimed_host, alive, CASE WHEN {_LAPSED} THEN 0 ELSE lease_expires_at END AS lease_expires_at, completed_at FROM {{tasks}})
    WHERE NOT (expires_at <> 0 AND expires_at < {THEN} AND status <> 'in_progress') AND NOT (status IN ('completed', 'canceled') AND completed_at <> 0 AND completed_at < {THEN - 3600})"""


def cursors(murmurs):
    return murmurs.filter((F.col("topic") == "purchase") & (F.col("sec") < NOW) & F.col("author").isin("u3", "u7", "u11")).groupBy(F.col("author").alias("reader")).agg(F.max("sec").alias("last_seen"))


@register("SELECT id, author, importance FROM {murmurs} WHERE importance IN ('critical', 'normal')")
def p21_heard(murmurs):
    return U.heard(murmurs, "normal").select("id", "author", "importance")


@register(f"""WITH c AS ({_CURSORS}), m AS (SELECT reader, id, author, topic, importance, sec FROM {{murmurs}} JOIN c ON sec > last_seen WHERE importance = 'critical' AND topic IN ('click', 'error') AND (topic <> 'click' OR author = reader))
    SELECT *, CAST(row_number() OVER (PARTITION BY reader ORDER BY {_RANK}, sec, id) AS INTEGER) AS place FROM m""")
def st7_unread(murmurs):
    return U.unread(murmurs, cursors(murmurs), "click", "focused", ["click", "error"])


@register(f"WITH c AS ({_CURSORS}) SELECT reader, last_seen FROM c WHERE reader NOT IN ('u3', 'u40') UNION ALL SELECT unnest(['u3', 'u40']), {NOW}")
def st7_cursors_after_reading(murmurs):
    readers = murmurs.select(F.col("author").alias("reader")).filter(F.col("reader").isin("u3", "u40"))
    return U.advanced(cursors(murmurs), readers, NOW)


@register(f"SELECT id, author, topic, sec FROM {{murmurs}} WHERE sec >= {NOW - 5 * 86400}")
def st9_kept(murmurs):
    return U.kept(murmurs, "sec", NOW, 5 * 86400).select("id", "author", "topic", "sec")


@register(f"SELECT id, sec, author FROM (SELECT id, sec, author FROM {{murmurs}} WHERE id % 3 <> 0 UNION ALL SELECT id, sec + 60, author FROM {{murmurs}} WHERE id % 3 = 0) WHERE sec >= {NOW - 5 * 86400}")
def r23_whispers_added(murmurs):
    own = murmurs.select("id", "sec", "author")
    new = own.filter("id % 3 < 2").withColumn("sec", F.col("sec") + 60)
    return U.new_messages(own.filter("id % 3 <> 0"), new.unionByName(new.withColumn("sec", F.col("sec") + 5)), NOW, 5 * 86400)


@register(_QUEUE)
def st10_reconciled(tasks):
    return U.reconciled(tasks, THEN, "h1")


@register(f"WITH q AS ({_QUEUE}), e AS (SELECT id, priority, created_at, unnest(CASE WHEN target_agent = '' THEN ['building', 'machinery'] ELSE [target_agent] END) AS agent FROM q WHERE status = 'ready' AND target_agent IN ('', 'building', 'machinery')) SELECT agent, id, priority FROM e QUALIFY row_number() OVER (PARTITION BY agent ORDER BY priority, created_at, id) = 1")
def st10_next_for_agents(tasks):
    return U.next_for_each(U.reconciled(tasks, THEN, "h1"), AGENTS)


@register("SELECT id, priority, target_agent, created_at FROM {tasks} WHERE status = 'ready' AND target_agent IN ('', 'machinery') ORDER BY priority, created_at, id")
def r27_ready_for_agent(tasks):
    return U.ready_for(tasks, "machinery").select("id", "priority", "target_agent", "created_at")


@register("SELECT id, status, dedup_key FROM (SELECT *, CASE WHEN dedup_key <> '' AND status NOT IN ('completed', 'canceled') THEN row_number() OVER (PARTITION BY dedup_key, status NOT IN ('completed', 'canceled') ORDER BY created_at, id) ELSE 1 END AS place FROM {tasks}) WHERE place = 1")
def st11_active_unique(tasks):
    return U.active_unique(tasks).select("id", "status", "dedup_key")


@register("""WITH old AS (SELECT * FROM {tasks} WHERE id % 8 <> 0), act AS (SELECT * FROM old WHERE status NOT IN ('completed', 'canceled')), new AS (SELECT * FROM {tasks} WHERE id % 8 = 0),
    u AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY created_at, id) AS place FROM new), fresh AS (SELECT * EXCLUDE (place) FROM u WHERE dedup_key = '' OR (place = 1 AND dedup_key NOT IN (SELECT dedup_key FROM act WHERE dedup_key <> ''))),
    k AS (SELECT (SELECT count(*) FROM act) + (SELECT count(*) FROM fresh) - 3000 AS n), go AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY priority DESC, created_at, id) AS place FROM old WHERE status = 'ready'), k WHERE place <= n)
    SELECT id, status, priority FROM (SELECT * FROM old UNION ALL SELECT * FROM fresh) WHERE id NOT IN (SELECT id FROM go)""")
def r26_o11_added_to_cap(tasks):
    return U.added(tasks.filter("id % 8 <> 0"), tasks.filter("id % 8 = 0"), 3000).select("id", "status", "priority")


_ACTION = "CASE topic WHEN 'signup' THEN 'claim' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'cancel' WHEN 'click' THEN 'extend' ELSE 'add' END"


@register(f"""WITH l AS (SELECT file AS task, sec, id, author AS note, {_ACTION} AS action FROM {{murmurs}}), e AS (SELECT task, min((sec, id)) AS e FROM l WHERE action IN ('complete', 'cancel') GROUP BY 1), o AS (SELECT l.* FROM l LEFT JOIN e ON e.task = l.task WHERE e.e IS NULL OR (sec, id) <= e.e)
    SELECT task, arg_max(CASE action WHEN 'complete' THEN 'completed' WHEN 'cancel' THEN 'canceled' WHEN 'add' THEN 'ready' ELSE 'in_progress' END, (sec, id)) AS status, count(*) FILTER (WHERE action = 'claim') AS attempts, max(sec) FILTER (WHERE action IN ('claim', 'extend')) AS leased,
    max(note) FILTER (WHERE action IN ('complete', 'cancel')) AS note, max(sec) AS updated FROM o GROUP BY 1""")
def r26_task_replay(murmurs):
    action = F.when(F.col("topic") == "signup", "claim").when(F.col("topic") == "purchase", "complete").when(F.col("topic") == "error", "cancel").when(F.col("topic") == "click", "extend").otherwise("add")
    return U.replayed(murmurs.select(F.col("file").alias("task"), "sec", "id", F.col("author").alias("note"), action.alias("action")))
