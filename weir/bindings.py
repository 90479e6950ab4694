"""Logical tables (commits, diffs, pull requests, ...) as projections of the given tables.

Every operator works on the logical schemas; only this module knows the given ones. ``SQL`` has the
same projections as common table expressions, for the SQL of the queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def unix(c: str) -> Column:
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def commits(spark: SparkSession, d: str) -> DataFrame:
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"), (F.col("c_nationkey") % 5).cast("long").alias("repo_id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("hash"),
        F.col("c_name").alias("author"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("message"), unix("o_orderdate").alias("timestamp"))


def diffs(spark: SparkSession, d: str) -> DataFrame:
    item, p = _t(spark, d, "lineitem"), _t(spark, d, "part")
    return item.join(p, item.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("commit_id"), F.concat_ws("/", F.translate("p_brand", "#", "_"), F.translate("p_type", " ", "_")).alias("path")).distinct()


def pull_requests(spark: SparkSession, d: str) -> DataFrame:
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    at, day = unix("o_orderdate"), 86400
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("title"), F.col("c_name").alias("author"),
        F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "merged").otherwise("closed").alias("state"), at.alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", at + 5 * day).alias("merged_at"), (at + 3 * day).alias("updated_at"))


def pr_comments(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("pr_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("author"),
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("ship/"), "l_linestatus")).alias("path"), unix("l_shipdate").alias("created_at"), "l_linenumber",
        F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string"), F.lit(" flag "), "l_returnflag").alias("body"))


def pr_commits(spark: SparkSession, d: str) -> DataFrame:
    """Orders without lines are pull requests without commits; every fifth part number points to a commit that may not exist."""
    sha = F.col("l_orderkey") + F.col("l_linenumber") - 1 + F.when(F.col("l_partkey") % 5 == 0, 100_000_000).otherwise(0)
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("pr_id"), F.lpad(sha.cast("string"), 12, "0").alias("sha")).distinct()


def murmurs(spark: SparkSession, d: str) -> DataFrame:
    k, user = F.get_json_object("props", "$.k").cast("int").cast("string"), F.col("user_id")
    return _t(spark, d, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("u"), user.cast("string")).alias("author"), F.col("ts").cast("timestamp").alias("ts"), unix("ts").alias("sec"), F.col("event_type").alias("topic"),
        F.concat(F.lit("pkg"), k, F.lit("/d"), (user % 13).cast("string"), F.lit("/f"), (F.col("event_id") % 3).cast("string")).alias("file"), F.col("props").alias("content"), "value",
        F.when(F.col("value") >= 120, "critical").when(F.col("value") >= 60, "normal").otherwise("ambient").alias("importance"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Call edges src -> dst from each part to the one in the order's next line, with cycles."""
    nxt = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return _t(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), nxt.alias("dst")).filter("dst is not null").distinct()


def symbol_edges(spark: SparkSession, d: str) -> DataFrame:
    """Resolved calls from each line's symbol to that of the order's next line."""
    by = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    own = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = _t(spark, d, "lineitem").select(
        own.alias("src_symbol_id"), F.lead(own).over(by).alias("dst_symbol_id"), F.concat(F.lit("f"), (F.lead("l_suppkey").over(by) % 100).cast("string")).alias("dst_name"), F.col("l_partkey").alias("src_blob_id"),
        F.when(F.col("l_quantity") < 45, "call").otherwise("import").alias("kind"), F.when(F.col("l_returnflag") == "A", "extracted").when(F.col("l_returnflag") == "R", "inferred").otherwise("ambiguous").alias("confidence"))
    return rows.filter("dst_symbol_id is not null")


def repos(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lower("r_name").alias("name"))


def work_items(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("open").alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_custkey").alias("owner"))


def dependencies(spark: SparkSession, d: str) -> DataFrame:
    """An item depends on the owner's item before it."""
    o = _t(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("before"))
    return o.filter("before is not null").select(F.col("o_orderkey").alias("issue_id"), F.col("before").alias("depends_on_id"), F.when(F.col("o_orderkey") % 4 == 0, "related").otherwise("blocks").alias("type"))


def commit_parents(spark: SparkSession, d: str) -> DataFrame:
    """A commit's parent is its author's commit before it; every seventh is a merge and has the one before that as well."""
    by = W.partitionBy("o_custkey").orderBy("o_orderkey")
    o = _t(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(by).alias("one"), F.lag("o_orderkey", 2).over(by).alias("two"))
    parents = F.array_compact(F.array("one", F.when(F.col("o_orderkey") % 7 == 0, F.col("two"))))
    return o.select(F.col("o_orderkey").alias("commit_id"), F.explode(parents).alias("parent_id"))


def transcript(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.col("role").alias("type"), F.col("text").alias("content"))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source", "lang")


def refs(spark: SparkSession, d: str) -> DataFrame:
    """Every commit is the tip of a branch: main, master or dev."""
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    k = F.col("o_orderkey") % 3
    return o.join(c, o.o_custkey == c.c_custkey).select((F.col("c_nationkey") % 5).cast("long").alias("repo_id"), F.when(k == 0, "refs/heads/main").when(k == 1, "refs/heads/master").otherwise("refs/heads/dev").alias("name"), F.col("o_orderkey").alias("commit_id"))


def file_revs(spark: SparkSession, d: str) -> DataFrame:
    part = F.col("l_partkey")
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.concat(F.lit("src/"), (part % 7).cast("string"), F.lit("/p"), part.cast("string"), F.lit(".go")).alias("path"), part.alias("blob_id")).distinct()


def blobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 4
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(k == 0, "go").when(k == 1, "python").when(k == 2, "rust").alias("language"))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("l_quantity").cast("int")
    return _t(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("blob_id"), F.concat(F.lit("f"), (F.col("l_suppkey") % 100).cast("string")).alias("name"),
        F.when(F.col("l_returnflag") == "A", "function").when(F.col("l_returnflag") == "R", "method").otherwise("class").alias("kind"), line.alias("line"),
        (line + F.col("l_linenumber") * 10).alias("end_line"), F.when(F.col("l_linestatus") == "F", "error").otherwise("string").alias("return_type"))


def symbol_refs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("blob_id"), F.concat(F.lit("f"), (F.col("l_orderkey") % 100).cast("string")).alias("ref_name"),
        (F.col("l_orderkey") % 60).cast("int").alias("line"))


def links(spark: SparkSession, d: str) -> DataFrame:
    """Links of documents of twenty pages each: host, label and time."""
    return _t(spark, d, "pages").select(F.floor(F.col("page_id") / 20).alias("document"), F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"), F.col("url").alias("label"), F.col("page_id").alias("seen"))


def issues(spark: SparkSession, d: str) -> DataFrame:
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("title"), F.col("c_mktsegment").alias("body"), F.col("c_name").alias("author"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("state"), unix("o_orderdate").alias("updated_at"))


def issue_comments(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("issue_id"), F.concat(F.lit("quantity "), F.col("l_quantity").cast("int").cast("string"), F.lit(" flag "), "l_returnflag").alias("body"))


def comments(spark: SparkSession, d: str) -> DataFrame:
    """Comments of source files, line or block."""
    return _t(spark, d, "part").select(F.col("p_partkey").alias("blob_id"), F.col("p_type").alias("text"), F.when(F.col("p_partkey") % 3 == 0, "block").otherwise("line").alias("kind"), F.col("p_size").alias("line"))


def history(spark: SparkSession, d: str) -> DataFrame:
    """Dated entries of teams, with ids that start with the date."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return _t(spark, d, "events").select(
        F.concat_ws("-", day, F.col("event_id").cast("string")).alias("id"), day.alias("date"), unix("ts").alias("created_at"), F.concat(F.lit("team"), (F.col("user_id") % 5).cast("string")).alias("team"), F.col("event_type").alias("kind"))


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """A queue of tasks in all states, some with a lease, a time to expire or the key of another's."""
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    k, at, day = F.col("o_orderkey"), unix("o_orderdate"), 86400
    status = F.when(k % 4 == 0, "ready").when(k % 4 == 1, "in_progress").when(k % 4 == 2, "completed").otherwise("canceled")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        k.alias("id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), status.alias("status"), F.when(k % 3 == 0, "").otherwise(F.lower("c_mktsegment")).alias("target_agent"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("k"), F.col("o_custkey").cast("string"))).alias("dedup_key"), at.alias("created_at"), F.when(k % 7 == 0, at + 30 * day).otherwise(0).alias("expires_at"),
        F.when(k % 4 == 1, F.concat(F.lit("h"), (k % 3).cast("string"))).otherwise("").alias("claimed_host"), (k % 2 == 0).alias("alive"), F.when(k % 4 == 1, at + (k % 60) * day).otherwise(0).alias("lease_expires_at"),
        F.when(k % 4 >= 2, at + (k % 20) * day).otherwise(0).alias("completed_at"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Recorded sessions, with what their classification goes by."""
    k, user, at = F.col("o_orderkey"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.col("o_orderdate")
    reason = F.element_at(F.array(*map(F.lit, ("canceled", "stopped", "rate_limited", "recovered", ""))), F.substring("o_orderpriority", 1, 1).cast("int"))
    return _t(spark, d, "orders").select(
        k.alias("id"), F.concat_ws("-", F.date_format(at, "yyyy-MM-dd'T'HH-mm"), user, F.concat(F.lit("Ox"), k.cast("string"))).alias("name"), user.alias("user"), unix("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("title"),
        (F.col("o_orderstatus") == "P").alias("recording"), reason.alias("stop_reason"), (k % 3 == 0).alias("uploaded"), (k % 2 == 0).alias("alive"), (k % 25).cast("int").alias("entries"), (k % 5 == 0).alias("has_raw"),
        (k % 11 == 0).alias("suspended"), (k % 10 == 0).alias("subagent"), (k % 100 / 100).alias("score"), F.when(k % 4 == 0, "skip").when(k % 4 == 1, "local_only").when(k % 4 == 2, "share").otherwise("").alias("category"))


def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """Tool entries of sessions, their input as JSON."""
    item, part = _t(spark, d, "lineitem"), F.col("l_partkey")
    name = F.when(F.col("l_returnflag") == "A", "Edit").when(F.col("l_returnflag") == "R", "write").when(F.col("l_linestatus") == "O", "Task").otherwise("Read")
    where = F.when(part % 3 == 0, "/home/u/repo/internal/p").when(part % 3 == 1, "/srv/x/pkg/q").otherwise("/tmp/other/r")
    key = F.when(part % 2 == 0, "file_path").otherwise("path")
    return item.select(
        F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("seq"), name.alias("tool"), F.concat(F.lit('{"'), key, F.lit('": "'), where, part.cast("string"), F.lit('.go"}')).alias("input"), unix("l_shipdate").alias("sec"),
        (F.col("l_discount") > 0.08).alias("failed"), F.col("l_quantity").cast("long").alias("entries"))


def plans(spark: SparkSession, d: str) -> DataFrame:
    """Saved plans, a day apart."""
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("id"), (F.lit(1704067200) + F.col("item_id") * 86400).alias("created_at"), F.col("text").alias("content"))


def keyframes(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of a discussion (a host) by chapter; some have no type."""
    k = F.col("page_id")
    kind = F.element_at(F.array(*map(F.lit, ("slide", "", "code", "diagram"))), (k % 4 + 1).cast("int"))
    return _t(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]+)", 1).alias("discussion"), F.regexp_extract("url", "://[^/?#]+/([^/?#]*)", 1).alias("chapter"), (k * 7919 % 3600).alias("seconds"), kind.alias("content_type"), k.alias("id"))


def settings(spark: SparkSession, d: str) -> DataFrame:
    """Values of one setting in each layer; empty where unset."""
    k = F.col("c_custkey")
    layer = lambda name, n, *values: F.coalesce(F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int")), F.lit("")).alias(name)
    return _t(spark, d, "customer").select(k.alias("id"), layer("env", 5, "auto", "", "", "", ""), layer("kb", 3, "disabled", "manual", ""), layer("own", 4, "", "auto", "disabled", "manual"), F.lit("manual").alias("fallback"))


def blob_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changed files with the blobs before and after; added ones have none before, deleted ones none after."""
    flag = F.col("l_returnflag")
    return _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("commit_id"), F.concat(F.lit("src/p"), F.col("l_partkey").cast("string"), F.lit(".go")).alias("path"),
        F.when(flag != "A", F.col("l_suppkey")).alias("old_blob_id"), F.when(flag != "R", F.col("l_partkey")).alias("new_blob_id"))


TABLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        commits, diffs, pull_requests, pr_comments, pr_commits, murmurs, edges, symbol_edges, repos, work_items, dependencies, transcript, ledger, refs, file_revs, blobs, symbols, symbol_refs, links, issues, issue_comments, comments,
        history, tasks, sessions, tool_calls, plans, keyframes, settings, blob_changes, commit_parents)
}

_U = "CAST(floor(epoch({})) AS BIGINT)"
SQL = {
    "commits": f"SELECT o_orderkey AS id, CAST(c_nationkey % 5 AS BIGINT) AS repo_id, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS hash, c_name AS author, o_orderpriority || ' ' || o_orderstatus AS message, {_U.format('o_orderdate')} AS timestamp FROM orders JOIN customer ON o_custkey = c_custkey",
    "diffs": "SELECT DISTINCT l_orderkey AS commit_id, replace(p_brand, '#', '_') || '/' || replace(p_type, ' ', '_') AS path FROM lineitem JOIN part ON l_partkey = p_partkey",
    "pull_requests": f"SELECT o_orderkey AS id, o_orderkey AS number, o_orderpriority AS title, c_name AS author, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'merged' ELSE 'closed' END AS state, {_U.format('o_orderdate')} AS created_at, CASE WHEN o_orderstatus = 'F' THEN {_U.format('o_orderdate')} + 432000 END AS merged_at, {_U.format('o_orderdate')} + 259200 AS updated_at FROM orders JOIN customer ON o_custkey = c_custkey",
    "pr_comments": f"SELECT l_orderkey AS pr_id, 's' || l_suppkey AS author, CASE WHEN l_returnflag <> 'N' THEN 'ship/' || l_linestatus END AS path, {_U.format('l_shipdate')} AS created_at, l_linenumber, 'supplier ' || l_suppkey || ' flag ' || l_returnflag AS body FROM lineitem",
    "pr_commits": "SELECT DISTINCT l_orderkey AS pr_id, lpad(CAST(l_orderkey + l_linenumber - 1 + CASE WHEN l_partkey % 5 = 0 THEN 100000000 ELSE 0 END AS VARCHAR), 12, '0') AS sha FROM lineitem",
    "murmurs": f"SELECT event_id AS id, 'u' || user_id AS author, ts, {_U.format('ts')} AS sec, event_type AS topic, 'pkg' || k || '/d' || (user_id % 13) || '/f' || (event_id % 3) AS file, props AS content, value, CASE WHEN value >= 120 THEN 'critical' WHEN value >= 60 THEN 'normal' ELSE 'ambient' END AS importance FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)",
    "edges": "SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL",
    "work_items": "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'P' THEN 'in_progress' ELSE 'open' END AS status, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_orderdate AS created_at, o_custkey AS owner FROM orders",
    "dependencies": "SELECT o_orderkey AS issue_id, before AS depends_on_id, CASE WHEN o_orderkey % 4 = 0 THEN 'related' ELSE 'blocks' END AS type FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) WHERE before IS NOT NULL",
    "transcript": "SELECT conv_id AS session, turn AS seq, role AS type, text AS content FROM conversations",
    "refs": "SELECT CAST(c_nationkey % 5 AS BIGINT) AS repo_id, CASE o_orderkey % 3 WHEN 0 THEN 'refs/heads/main' WHEN 1 THEN 'refs/heads/master' ELSE 'refs/heads/dev' END AS name, o_orderkey AS commit_id FROM orders JOIN customer ON o_custkey = c_custkey",
    "file_revs": "SELECT DISTINCT l_orderkey AS commit_id, 'src/' || (l_partkey % 7) || '/p' || l_partkey || '.go' AS path, l_partkey AS blob_id FROM lineitem",
    "blobs": "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 2 THEN 'rust' END AS language FROM part",
    "symbols": "SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS blob_id, 'f' || (l_suppkey % 100) AS name, CASE l_returnflag WHEN 'A' THEN 'function' WHEN 'R' THEN 'method' ELSE 'class' END AS kind, CAST(trunc(l_quantity) AS INTEGER) AS line, CAST(trunc(l_quantity) AS INTEGER) + l_linenumber * 10 AS end_line, CASE l_linestatus WHEN 'F' THEN 'error' ELSE 'string' END AS return_type FROM lineitem",
    "symbol_refs": "SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS blob_id, 'f' || (l_orderkey % 100) AS ref_name, CAST(l_orderkey % 60 AS INTEGER) AS line FROM lineitem",
    "links": "SELECT page_id // 20 AS document, regexp_extract(url, '://([^/?#]+)', 1) AS host, url AS label, page_id AS seen FROM pages",
    "issues": f"SELECT o_orderkey AS number, o_orderpriority AS title, c_mktsegment AS body, c_name AS author, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'closed' END AS state, {_U.format('o_orderdate')} AS updated_at FROM orders JOIN customer ON o_custkey = c_custkey",
    "issue_comments": "SELECT l_orderkey AS issue_id, 'quantity ' || CAST(trunc(l_quantity) AS INTEGER) || ' flag ' || l_returnflag AS body FROM lineitem",
    "comments": "SELECT p_partkey AS blob_id, p_type AS text, CASE WHEN p_partkey % 3 = 0 THEN 'block' ELSE 'line' END AS kind, p_size AS line FROM part",
    "history": f"SELECT strftime(ts, '%Y-%m-%d') || '-' || event_id AS id, strftime(ts, '%Y-%m-%d') AS date, {_U.format('ts')} AS created_at, 'team' || (user_id % 5) AS team, event_type AS kind FROM events",
    "symbol_edges": "SELECT * FROM (SELECT l_orderkey * 8 + l_linenumber AS src_symbol_id, lead(l_orderkey * 8 + l_linenumber) OVER w AS dst_symbol_id, 'f' || (lead(l_suppkey) OVER w % 100) AS dst_name, l_partkey AS src_blob_id, CASE WHEN l_quantity < 45 THEN 'call' ELSE 'import' END AS kind, CASE l_returnflag WHEN 'A' THEN 'extracted' WHEN 'R' THEN 'inferred' ELSE 'ambiguous' END AS confidence FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) WHERE dst_symbol_id IS NOT NULL",
    "repos": "SELECT CAST(r_regionkey AS BIGINT) AS id, lower(r_name) AS name FROM region",
    "tasks": f"SELECT o_orderkey AS id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, CASE o_orderkey % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'canceled' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE lower(c_mktsegment) END AS target_agent, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'k' || o_custkey END AS dedup_key, {_U.format('o_orderdate')} AS created_at, CASE WHEN o_orderkey % 7 = 0 THEN {_U.format('o_orderdate')} + 2592000 ELSE 0 END AS expires_at, CASE WHEN o_orderkey % 4 = 1 THEN 'h' || (o_orderkey % 3) ELSE '' END AS claimed_host, o_orderkey % 2 = 0 AS alive, CASE WHEN o_orderkey % 4 = 1 THEN {_U.format('o_orderdate')} + (o_orderkey % 60) * 86400 ELSE 0 END AS lease_expires_at, CASE WHEN o_orderkey % 4 >= 2 THEN {_U.format('o_orderdate')} + (o_orderkey % 20) * 86400 ELSE 0 END AS completed_at FROM orders JOIN customer ON o_custkey = c_custkey",
    "sessions": f"SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H-%M') || '-c' || o_custkey || '-Ox' || o_orderkey AS name, 'c' || o_custkey AS user, {_U.format('o_orderdate')} AS created_at, o_orderpriority AS title, o_orderstatus = 'P' AS recording, ['canceled', 'stopped', 'rate_limited', 'recovered', ''][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS stop_reason, o_orderkey % 3 = 0 AS uploaded, o_orderkey % 2 = 0 AS alive, CAST(o_orderkey % 25 AS INTEGER) AS entries, o_orderkey % 5 = 0 AS has_raw, o_orderkey % 11 = 0 AS suspended, o_orderkey % 10 = 0 AS subagent, (o_orderkey % 100) / 100 AS score, CASE o_orderkey % 4 WHEN 0 THEN 'skip' WHEN 1 THEN 'local_only' WHEN 2 THEN 'share' ELSE '' END AS category FROM orders",
    "tool_calls": f"SELECT l_orderkey AS session, l_linenumber AS seq, CASE WHEN l_returnflag = 'A' THEN 'Edit' WHEN l_returnflag = 'R' THEN 'write' WHEN l_linestatus = 'O' THEN 'Task' ELSE 'Read' END AS tool, '{{\"' || CASE WHEN l_partkey % 2 = 0 THEN 'file_path' ELSE 'path' END || '\": \"' || CASE l_partkey % 3 WHEN 0 THEN '/home/u/repo/internal/p' WHEN 1 THEN '/srv/x/pkg/q' ELSE '/tmp/other/r' END || l_partkey || '.go\"}}' AS input, {_U.format('l_shipdate')} AS sec, l_discount > 0.08 AS failed, CAST(trunc(l_quantity) AS BIGINT) AS entries FROM lineitem",
    "commit_parents": "SELECT o_orderkey AS commit_id, unnest(list_filter([one, CASE WHEN o_orderkey % 7 = 0 THEN two END], lambda x: x IS NOT NULL)) AS parent_id FROM (SELECT o_orderkey, lag(o_orderkey) OVER w AS one, lag(o_orderkey, 2) OVER w AS two FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))",
    "plans": "SELECT item_id AS id, 1704067200 + item_id * 86400 AS created_at, text AS content FROM benchmark",
    "keyframes": "SELECT regexp_extract(url, '://([^/?#]+)', 1) AS discussion, regexp_extract(url, '://[^/?#]+/([^/?#]*)', 1) AS chapter, page_id * 7919 % 3600 AS seconds, ['slide', '', 'code', 'diagram'][CAST(page_id % 4 + 1 AS INTEGER)] AS content_type, page_id AS id FROM pages",
    "settings": "SELECT c_custkey AS id, ['auto', '', '', '', ''][CAST(c_custkey % 5 + 1 AS INTEGER)] AS env, ['disabled', 'manual', ''][CAST(c_custkey % 3 + 1 AS INTEGER)] AS kb, ['', 'auto', 'disabled', 'manual'][CAST(c_custkey % 4 + 1 AS INTEGER)] AS own, 'manual' AS fallback FROM customer",
    "blob_changes": "SELECT l_orderkey AS commit_id, 'src/p' || l_partkey || '.go' AS path, CASE WHEN l_returnflag <> 'A' THEN l_suppkey END AS old_blob_id, CASE WHEN l_returnflag <> 'R' THEN l_partkey END AS new_blob_id FROM lineitem",
    "ledger": "SELECT doc_id AS id, text AS content, source, lang FROM documents",
}


def with_tables(sql: str) -> str:
    """``sql`` with the common table expressions that it names as ``{commits}`` and so on put before it."""
    used = [k for k in SQL if "{" + k + "}" in sql]
    body = sql
    for k in used:
        body = body.replace("{" + k + "}", f"t_{k}")
    ctes = ", ".join(f"t_{k} AS ({SQL[k]})" for k in used)
    recursive = body.lstrip().upper().startswith("RECURSIVE ")
    body = body.lstrip()[len("RECURSIVE ") :] if recursive else body
    head = f"WITH {'RECURSIVE ' if recursive else ''}{ctes}"
    return f"{head}, {body.lstrip()[5:]}" if body.lstrip().upper().startswith("WITH ") else f"{head} {body}"
