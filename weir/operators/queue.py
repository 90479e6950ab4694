"""The message bus and the task queue, as read models: what a reader gets next, and what a queue looks like at a time.

Tasks are (id, priority, status, target_agent, dedup_key, created_at, expires_at, claimed_host, alive,
lease_expires_at, completed_at), times in unix seconds and 0 where unset; ``alive`` says whether the
process that claimed a task still runs, which is known on its own host only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Which messages each grade of attention lets through, and the order of their importance.
ATTENTION = {"focused": ("critical",), "normal": ("critical", "normal"), "all": ("critical", "normal", "ambient")}
IMPORTANCE = ("critical", "normal", "ambient")
#: The states of a task that has ended, and for how many seconds it stays.
ENDED, RETENTION = ("completed", "canceled"), 3600


def importance_rank(c: Column) -> Column:
    out = F.lit(len(IMPORTANCE))
    for k, name in reversed(list(enumerate(IMPORTANCE))):
        out = F.when(c == name, k).otherwise(out)
    return out


def heard(messages: DataFrame, attention: str) -> DataFrame:
    """Messages important enough for that attention; an unknown one counts as normal. "all" leaves none out."""
    levels = ATTENTION.get(attention, ATTENTION["normal"])
    return messages if len(levels) == len(IMPORTANCE) else messages.filter(F.col("importance").isin(*levels))


def unread(messages: DataFrame, cursors: DataFrame, personal: str, attention: str = "normal", topics: list[str] | None = None, most: int | None = None) -> DataFrame:
    """For each reader (cursors: reader, last_seen) what came after the cursor, most important first; with ``most`` no more than that for each.

    With ``most`` each task keeps as many of a reader's at most before they are put together.

    Every message is for all readers, but those of the topic ``personal`` are only for their author.
    Messages meet the readers day by day: a reader has a row for each day since the cursor, which is
    never more than what comes out.
    """
    own = heard(messages, attention)
    own = own if topics is None else own.filter(F.col("topic").isin(*topics))
    day = lambda c: F.floor(F.col(c) / 86400)
    last = own.agg(F.max("sec")).first()[0] or 0
    days = cursors.filter(F.col("last_seen") <= last).select("*", F.explode(F.sequence(day("last_seen"), F.lit(last // 86400).cast("long"))).alias("day"))
    after = F.col("sec") > F.col("last_seen")
    common = own.filter(F.col("topic") != personal).withColumn("day", day("sec")).join(days, "day").filter(after)
    mine = own.filter(F.col("topic") == personal).join(cursors, (F.col("author") == F.col("reader")) & after)
    cols = ["reader", "id", "author", "topic", "importance", "sec"]
    rows = common.select(*cols).unionByName(mine.select(*cols))
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("reader").orderBy(importance_rank(F.col("importance")), "sec", "id")))
    return rows if most is None else rows.filter(F.col("place") <= most)


def advanced(cursors: DataFrame, readers: DataFrame, now: int) -> DataFrame:
    """Cursors after ``readers`` (reader) have read: theirs at ``now``, new ones added, all others as before."""
    moved = readers.select("reader").distinct().withColumn("last_seen", F.lit(now).cast("long"))
    return cursors.join(moved.select("reader"), "reader", "left_anti").unionByName(moved)


def kept(rows: DataFrame, column: str, now: int, age: int) -> DataFrame:
    """What pruning leaves: rows not older than ``age`` seconds."""
    return rows.filter(F.col(column) >= now - age)


def new_messages(old: DataFrame, new: DataFrame, now: int, age: int) -> DataFrame:
    """The bus after an insert that ignores ids it has (of equal new ids the earliest stays), pruned by age."""
    first = new.groupBy("id").agg(F.min(F.struct("sec", *(c for c in new.columns if c not in ("id", "sec")))).alias("r")).select("id", "r.*")
    return kept(old.unionByName(first.join(old.select("id"), "id", "left_anti").select(*old.columns)), "sec", now, age)


def reconciled(tasks: DataFrame, now: int, host: str) -> DataFrame:
    """The queue at ``now``: leases that ran out and claims of dead processes on ``host`` are ready again, expired and long ended tasks are gone.

    A task that is being worked on never expires.
    """
    busy = F.col("status") == "in_progress"
    lapsed = busy & (((F.col("lease_expires_at") != 0) & (F.col("lease_expires_at") < now)) | ((F.lit(host) != "") & (F.col("claimed_host") == host) & ~F.col("alive")))
    rows = tasks.withColumn("lapsed", lapsed)
    rows = rows.withColumns({
        "status": F.when(F.col("lapsed"), "ready").otherwise(F.col("status")), "claimed_host": F.when(F.col("lapsed"), "").otherwise(F.col("claimed_host")),
        "lease_expires_at": F.when(F.col("lapsed"), 0).otherwise(F.col("lease_expires_at")),
    }).drop("lapsed")
    expired = (F.col("expires_at") != 0) & (F.col("expires_at") < now) & (F.col("status") != "in_progress")
    old = F.col("status").isin(*ENDED) & (F.col("completed_at") != 0) & (F.col("completed_at") < now - RETENTION)
    return rows.filter(~expired & ~old)


def ready_for(tasks: DataFrame, agent: str) -> DataFrame:
    """Ready tasks for anyone or for this kind of agent, in the order in which they are claimed."""
    own = tasks.filter((F.col("status") == "ready") & F.col("target_agent").isin("", agent))
    return own.orderBy("priority", "created_at", "id")


def next_for_each(tasks: DataFrame, agents: list[str]) -> DataFrame:
    """The task that each kind of agent would claim next: one row for a kind, from partial minima."""
    own = tasks.filter((F.col("status") == "ready") & F.col("target_agent").isin("", *agents))
    kinds = F.when(F.col("target_agent") == "", F.array(*map(F.lit, agents))).otherwise(F.array("target_agent"))
    best = own.select(F.explode(kinds).alias("agent"), "priority", "created_at", "id").groupBy("agent").agg(F.min(F.struct("priority", "created_at", "id")).alias("t"))
    return best.select("agent", "t.id", "t.priority")


def active_unique(tasks: DataFrame) -> DataFrame:
    """Tasks without later ones that have the key of one that hasn't ended; tasks without a key all stay."""
    keyed = (F.col("dedup_key") != "") & ~F.col("status").isin(*ENDED)
    place = F.row_number().over(W.partitionBy("dedup_key").orderBy("created_at", "id"))
    first = tasks.filter(keyed).withColumn("place", place).filter("place = 1").drop("place")
    return tasks.filter(~keyed).unionByName(first)


def added(tasks: DataFrame, new: DataFrame, cap: int) -> DataFrame:
    """The queue after adding ``new`` (ready tasks): keys that are active are refused, then the cap on active tasks is held.

    Over the cap the least urgent ready tasks go, the oldest of them first; tasks in work stay. The
    number of active tasks is one figure, and what goes is the head of one sort, so nothing but that is collected.
    """
    active = tasks.filter(~F.col("status").isin(*ENDED))
    keys = active.filter("dedup_key <> ''").select("dedup_key")
    fresh = active_unique(new).filter("dedup_key = ''").unionByName(active_unique(new).filter("dedup_key <> ''").join(keys, "dedup_key", "left_anti").select(*new.columns))
    over = active.count() + fresh.count() - cap
    rows = tasks.unionByName(fresh.select(*tasks.columns))
    if over <= 0:
        return rows
    go = tasks.filter("status = 'ready'").orderBy(F.desc("priority"), "created_at", "id").limit(over).select("id")
    return rows.join(go, "id", "left_anti")


def replayed(log: DataFrame) -> DataFrame:
    """The state of each task after its log (task, sec, id, action, note): add, claim, extend, complete, cancel.

    What comes after the first end of a task changes nothing. The result says how often it was claimed,
    when its lease was last set, and the note of its end.
    """
    end = F.min(F.when(F.col("action").isin("complete", "cancel"), F.struct("sec", "id"))).over(W.partitionBy("task"))
    own = log.withColumn("end", end).filter(F.col("end").isNull() | (F.struct("sec", "id") <= F.col("end")))
    status = F.when(F.col("action") == "complete", "completed").when(F.col("action") == "cancel", "canceled").when(F.col("action") == "add", "ready").otherwise("in_progress")
    at = F.struct("sec", "id")
    return own.groupBy("task").agg(
        F.max_by(status, at).alias("status"), F.count_if(F.col("action") == "claim").alias("attempts"), F.max(F.when(F.col("action").isin("claim", "extend"), F.col("sec"))).alias("leased"),
        F.max_by(F.when(F.col("action").isin("complete", "cancel"), F.col("note")), at).alias("note"), F.max("sec").alias("updated"))


def lease_log(log: DataFrame, lease: int, until: int) -> DataFrame:
    """Each change of a task's state up to ``until``: task, sec, status, why, attempts.

    ``log`` (task, sec, id, action) says what was done: add, claim, extend, complete, cancel. A claim or an
    extension holds for ``lease`` seconds; if nothing comes until then, the task is ready again (why:
    lapsed). What comes after the end changes nothing, and the task is pruned when its retention is over;
    ids are not used again.
    """
    by = W.partitionBy("task").orderBy("sec", "id")
    ends = F.col("action").isin("complete", "cancel")
    before = F.coalesce(F.sum(ends.cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = log.filter(F.col("sec") <= until).withColumns({"before": before, "attempts": F.sum((F.col("action") == "claim").cast("long")).over(by), "next": F.lead("sec").over(by)}).filter("before = 0")
    status = F.when(F.col("action") == "add", "ready").when(F.col("action") == "complete", "completed").when(F.col("action") == "cancel", "canceled").otherwise("in_progress")
    held = F.col("action").isin("claim", "extend")
    due = F.col("sec") + F.when(held, lease).when(ends, RETENTION)
    later = F.when(ends | (held & (F.col("next").isNull() | (F.col("next") > due))), F.struct(due.alias("sec"), F.when(ends, "").otherwise("ready").alias("status"), F.when(ends, "pruned").otherwise("lapsed").alias("why")))
    own = F.struct("sec", status.alias("status"), F.col("action").alias("why"))
    return rows.select("task", F.inline(F.filter(F.array(own, later), lambda x: x["sec"] <= until)), "attempts").select("task", "sec", "status", "why", "attempts")
