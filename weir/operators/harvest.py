"""Harvesting: recorded sessions, their tool calls and files, and what is told from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weir.functions import text as T

HOUR, DAY = 3600, 86400
#: Folders at which a path becomes relative, and files known by their name alone.
MARKERS = ("cmd", "internal", "pkg", "docs", "tests", ".github")
ROOT_FILES = ("go.mod", "go.sum", "Makefile", "CHANGELOG.md", ".goreleaser.yml")
#: Tools that change files; prefixes of local state.
EDITING = ("edit", "write", "multiedit")
LOCAL_STATE = (".beads/", ".claude/", ".codegraph/", ".cursor/")
#: Verbs that ask for work and phrases that ask for what is known.
ACTION_VERBS = "edit fix add make write create delete remove refactor rename implement build run commit push merge rebase deploy".split()
RECALL = (r"find", r"recall", r"how\s+did\s+we", r"how\s+do\s+we", r"has\s+anyone", r"what\s+is", r"what\s+are", r"explain", r"where\s+is", r"why\s+does", r"why\s+did", r"when\s+did", r"who\s+(wrote|owns|added|changed)", r"search\s+for", r"look\s+up")


def in_window(murmurs: DataFrame, since: int, until: int | None) -> DataFrame:
    """Murmurs from ``since`` to ``until``, both included; newest first is up to the reader."""
    rows = murmurs.filter(F.col("sec") >= since)
    return rows if until is None else rows.filter(F.col("sec") <= until)


def last_hours(murmurs: DataFrame, now: int, hours: int) -> DataFrame:
    """Murmurs of the last hours, of which 24 count at most."""
    return in_window(murmurs, now - min(hours, 24) * HOUR, now)


def relative(path: Column) -> Column:
    """A path from the first known folder on; else its last folder and name."""
    return T.bound(path, _relative)


def _relative(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for m in reversed(MARKERS):
        at = F.instr(path, f"/{m}/")
        out = F.when(at > 0, F.substr(path, at + 1)).otherwise(out)
    base, folder = F.substring_index(path, "/", -1), F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    rest = F.when(base.isin(*ROOT_FILES) | (F.instr(path, "/") == 0) | (folder == ""), base).otherwise(F.concat_ws("/", folder, base))
    return F.coalesce(out, rest)


def edited_files(calls: DataFrame) -> DataFrame:
    """session, files: the paths, sorted, that a session's tools changed; its input names them as file_path or path."""
    named = lambda key: T.bound(F.get_json_object("input", f"$.{key}"), lambda v: F.nullif(v, F.lit("")))
    path = F.coalesce(named("file_path"), named("path"))
    own = calls.filter(F.lower("tool").isin(*EDITING)).select("session", relative(path).alias("file")).filter("file is not null")
    return own.groupBy("session").agg(F.array_sort(F.collect_set("file")).alias("files"))


def listed(sessions: DataFrame, since: int, now: int) -> DataFrame:
    """Sessions since a time, without recordings that held nothing for 48 hours."""
    stub = F.col("recording") & ~F.col("has_raw") & (F.col("created_at") < now - 48 * HOUR)
    return sessions.filter((F.col("created_at") >= since) & ~stub)


def harvested(sessions: DataFrame, calls: DataFrame, summaries: DataFrame, since: int, until: int, now: int) -> DataFrame:
    """Sessions in a window, no subagents', with title, summary and files: a summary's (id, title, summary, files), else those of its tools."""
    own = listed(sessions, since, now).filter((F.col("created_at") <= until) & ~F.col("subagent"))
    told = summaries.select("id", F.nullif("title", F.lit("")).alias("better"), "summary", F.col("files").alias("told"))
    rows = own.join(told, "id", "left").join(edited_files(calls).withColumnRenamed("session", "id"), "id", "left")
    files = F.when(F.size("told") > 0, F.col("told")).otherwise(F.coalesce("files", F.array().cast("array<string>")))
    return rows.select("id", "name", "user", "created_at", F.coalesce("better", "title").alias("title"), "summary", files.alias("files"), "recording")


def as_murmurs(sessions: DataFrame) -> DataFrame:
    """A murmur of each harvested session for each of its files, so that they take part in conflicts."""
    return sessions.select(F.concat(F.lit("session:"), "name").alias("id"), F.col("user").alias("author"), F.lit("session").alias("topic"), F.col("created_at").alias("sec"), F.explode("files").alias("file"))


def resolved(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """Full names for what was asked (asked): an exact name, or the only one that ends in it after a hyphen; ``found`` tells how many do.

    Names end in an id without a hyphen, so the key is equal and nothing is compared pair by pair.
    """
    named = sessions.select("name", F.substring_index("name", "-", -1).alias("asked"))
    by_id = named.groupBy("asked").agg(F.min("name").alias("full"), F.count("*").alias("found"))
    exact = sessions.select(F.col("name").alias("asked"), F.col("name").alias("exact")).distinct()
    rows = asked.join(exact, "asked", "left").join(by_id, "asked", "left")
    n = F.when(F.col("exact").isNotNull(), 1).otherwise(F.coalesce("found", F.lit(0)))
    return rows.select("asked", F.when(F.col("exact").isNotNull(), F.col("exact")).when(n == 1, F.col("full")).when(n == 0, F.col("asked")).alias("name"), n.cast("long").alias("found"))


def user_of(name: Column) -> Column:
    """The user in a session's name: YYYY-MM-DDTHH-MM-user-id."""
    return F.regexp_extract(name, r"^\d{4}-\d\d-\d\dT\d\d-\d\d-(.+)-[^-]+$", 1)


def status(s: DataFrame) -> Column:
    """What a session is: recording, suspended, orphan, ghost, canceled, uploaded, paused or local."""
    done = F.when(F.col("stop_reason") == "canceled", "canceled").when(F.col("uploaded"), "uploaded").when(F.col("stop_reason") == "stopped", "paused").otherwise("local")
    dead = F.when(F.col("has_raw") | (F.col("entries") > 0), "orphan").otherwise("ghost")
    return F.when(~F.col("recording"), done).when(~F.col("alive"), dead).when(F.col("suspended"), "suspended").otherwise("recording")


def disposition(score: Column, upload: float, discard: float) -> Column:
    return F.when(score < discard, "discard").when(score < upload, "local_only").otherwise("upload")


def category_disposition(category: Column) -> Column:
    """An unknown category is uploaded."""
    return F.when(category == "skip", "discard").when(category == "local_only", "local_only").otherwise("upload")


def pruned(sessions: DataFrame, now: int, days: int) -> DataFrame:
    """What pruning leaves: sessions not older, and those whose name has no time."""
    at = F.unix_timestamp(F.try_to_timestamp(F.regexp_extract("name", r"^\d{4}-\d\d-\d\dT\d\d-\d\d", 0), F.lit("yyyy-MM-dd'T'HH-mm")))
    return sessions.filter(at.isNull() | (at >= now - days * DAY))


def from_start(entries: DataFrame, start: int) -> DataFrame:
    """Entries from a time on, and those without a time."""
    return entries.filter(F.col("sec").isNull() | (F.col("sec") >= start))


def is_noise(path: Column) -> Column:
    """Files that say nothing of the work: outside the project, temporary ones, local state."""
    out = path.startswith("../") | F.contains(F.substring_index(path, "/", -1), F.lit(".tmp."))
    for p in LOCAL_STATE:
        out = out | path.startswith(p)
    return out


def plan_marker(text: Column) -> Column:
    """Of the first heading that marks a plan: final, implementation or plan; null without one."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    kind = lambda x: F.when(x.rlike(r"(?i)^##\s+final\s+plan\b"), "final").when(x.rlike(r"(?i)^##\s+implementation\s+plan\b"), "implementation").when(x.rlike(r"(?i)^##\s+plan\b"), "plan")
    return F.get(F.filter(F.transform(lines, kind), lambda k: k.isNotNull()), 0)


def diagrams(text: Column) -> Column:
    """The closed mermaid blocks of a text."""
    return F.regexp_extract_all(text, F.lit(r"(?ms)^[ \t]*```mermaid[^\n]*\n(.*?)\n?^[ \t]*```[ \t]*$"), F.lit(1))


def task_calls(calls: DataFrame) -> DataFrame:
    """Of each session: how many tasks it handed on, with the entries and seconds they took to the next call.

    Of calls with the same number and second a task comes last, so that the result doesn't hang on the order of the rows.
    """
    task = F.coalesce(F.lower("tool") == "task", F.lit(False))
    nxt = F.lead("sec").over(W.partitionBy("session").orderBy(F.asc_nulls_last("seq"), F.asc_nulls_last("sec"), task))
    own = calls.withColumn("took", F.greatest(F.lit(0), F.coalesce(nxt - F.col("sec"), F.lit(0)))).filter(task)
    return own.groupBy("session").agg(F.count("*").alias("n"), F.sum("entries").alias("entries"), F.sum("took").alias("took"))


def tool_blocks(events: DataFrame) -> DataFrame:
    """Work blocks (author, sec, id, kind, failed): runs without a user or assistant entry, with counts of tools and failures, and whether files changed."""
    by = W.partitionBy("author").orderBy("sec", "id")
    work = ~F.col("kind").isin("user", "assistant")
    rows = events.withColumn("work", work).withColumn("start", (F.col("work") & ~F.coalesce(F.lag("work").over(by), F.lit(False))).cast("int"))
    rows = rows.withColumn("block", F.sum("start").over(by.rowsBetween(W.unboundedPreceding, 0))).filter("work")
    g = rows.groupBy("author", "block", "kind").agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"), F.min("sec").alias("first"), F.max("sec").alias("last"))
    tools = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat(x["kind"], F.lit(":"), x["n"].cast("string"))), ",")
    return g.groupBy("author", "block").agg(F.sum("n").alias("n"), tools.alias("tools"), F.sum("failed").alias("failed"), F.bool_or(F.col("kind") == "edit").alias("edits"), F.min("first").alias("first"), F.max("last").alias("last"))


def local_summary(t: DataFrame) -> DataFrame:
    """A summary of each session (session, seq, type, content) without a model: its topic, then how many entries of each kind.

    The topic is the first line that is no heading of the first user entry that isn't empty or a command.
    """
    said = F.trim(F.coalesce("content", F.lit("")))
    asks = (F.col("type") == "user") & (said != "") & ~said.startswith("/")
    g = t.groupBy("session").agg(F.count_if(F.col("type") == "user").alias("u"), F.count_if(F.col("type") == "assistant").alias("a"), F.count_if(F.col("type") == "tool").alias("k"), F.min_by(F.when(asks, said), F.when(asks, F.col("seq"))).alias("ask"))
    line = F.get(F.filter(F.transform(F.split("ask", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#")), 0)
    head = F.when(line.isNotNull(), F.concat(F.substring(line, 1, 120), F.lit("\n\n"))).otherwise("")
    tools = F.when(F.col("k") > 0, F.concat(F.lit(". "), F.col("k").cast("string"), F.lit(" tool calls"))).otherwise("")
    return g.select("session", F.concat(head, F.col("u").cast("string"), F.lit(" user messages, "), F.col("a").cast("string"), F.lit(" assistant responses"), tools).alias("summary"))


def flaws(title: Column, summary: Column, outcome: Column, category: Column, actions: Column, moments: Column, entries: Column) -> Column:
    """What is wrong with a session's summary, the first thing found; null if it is in order.

    A session that is to be skipped needs none. The richer parts are asked of sessions of more than 20
    entries (moments: more than 50).
    """
    t, s = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(summary, F.lit("")))
    size = F.octet_length
    wrong = F.when(size(t) < 3, "title too short").when(size(t) > 200, "title too long").when(size(s) < 20, "summary too short")
    wrong = wrong.when(~F.coalesce(outcome, F.lit("")).isin("success", "partial", "failed"), "no outcome")
    rich = entries > 20
    wrong = wrong.when(rich & (size(s) < 80), "summary not rich").when(rich & (actions < 3), "few actions").when((entries > 50) & (moments == 0), "no moments")
    return F.when(category == "skip", F.lit(None).cast("string")).otherwise(wrong)


def asks_for_recall(text: Column) -> Column:
    """Whether a prompt looks for what is known: long enough, with no leading verb of action, and with a phrase of recall."""
    t = F.trim(text)
    verb = F.lower(F.regexp_replace(F.regexp_extract(t, r"^[^ \t\n]+", 0), r"[,.;:!?]+$", ""))
    return (F.length(t) >= 20) & ~verb.isin(*ACTION_VERBS) & t.rlike(r"(?i)\b(" + "|".join(RECALL) + r")\b")
