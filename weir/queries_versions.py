"""Queries on histories, overlays, leases, written tables and followed sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weir.functions import text as T
from weir.operators import code as D
from weir.operators import queue as U
from weir.operators import versions as V
from weir.queries_queue import _ACTION
from weir.registry import ORACLES, QUERIES, register
from weir.sources import foreign, io, sinks, tail
from weir.tables import shared_folder

KNOWN = 852076800  # 1997-01-01
DEPTH = 10


@register(f"""RECURSIVE WITH k AS (SELECT id FROM {{commits}} WHERE timestamp < {KNOWN}), t AS (SELECT id FROM {{commits}} WHERE timestamp >= {KNOWN} AND id NOT IN (SELECT parent_id FROM {{commit_parents}})),
    w(commit_id, step) AS (SELECT id, 0 FROM t UNION SELECT p.parent_id, step + 1 FROM w JOIN {{commit_parents}} p ON p.commit_id = w.commit_id WHERE step < {DEPTH} AND p.parent_id NOT IN (SELECT id FROM k)),
    r AS (SELECT commit_id, min(step) AS near, max(step) AS far FROM w GROUP BY 1), c AS (SELECT DISTINCT r.commit_id FROM r JOIN {{commit_parents}} p USING (commit_id) WHERE far = {DEPTH} AND p.parent_id NOT IN (SELECT id FROM k) AND p.parent_id NOT IN (SELECT commit_id FROM r))
    SELECT commit_id, near, far, commit_id IN (SELECT commit_id FROM c) AS cut, row_number() OVER (ORDER BY far DESC, commit_id) AS number FROM r""")
def src1_new_commits(commits, commit_parents):
    tips = commits.filter(F.col("timestamp") >= KNOWN).select(F.col("id").alias("commit_id")).join(commit_parents.select(F.col("parent_id").alias("commit_id")), "commit_id", "left_anti")
    return V.new_commits(commit_parents, tips, commits.filter(F.col("timestamp") < KNOWN).select(F.col("id").alias("commit_id")), DEPTH)


@register("""WITH b AS (SELECT 'd' || id AS path, content, lang FROM {ledger}), o AS (SELECT path, content, lang, CAST(substr(path, 2) AS BIGINT) AS k FROM b), s AS (SELECT path, CASE WHEN k % 10 = 0 THEN 'rewritten ' || k WHEN k % 5 = 0 THEN replace(content, 'the', 'THE') ELSE content END AS content, CASE WHEN k % 10 = 0 THEN NULL ELSE lang END AS lang, k FROM o WHERE NOT k % 15 = 0 OR k % 10 = 0)
    SELECT path, lang, length(content) AS n_chars FROM s WHERE contains(content, 'THE') OR contains(content, 'rewritten')""")
def src3_overlaid(ledger):
    """A base and three overlays: the first changes, the second deletes, the third brings other texts without a language; searched as one."""
    base = ledger.select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("path"), "content", "lang")
    k = F.substring("path", 2, 20).cast("long")
    upper = base.filter(k % 5 == 0).withColumn("content", F.replace("content", F.lit("the"), F.lit("THE")))
    gone = base.filter(k % 15 == 0).select("path", F.lit(True).alias("deleted"))
    other = base.filter(k % 10 == 0).select("path", F.concat(F.lit("rewritten "), k.cast("string")).alias("content"))
    found = V.overlaid(base, [upper, gone, other]).filter(F.contains("content", F.lit("THE")) | F.contains("content", F.lit("rewritten")))
    return found.select("path", "lang", F.length("content").alias("n_chars"))


_UNTIL, _LEASE = 1704067200 + 20 * 86400, 2 * 86400


@register(f"""WITH l AS (SELECT file AS task, sec, id, {_ACTION} AS action FROM {{murmurs}} WHERE sec <= {_UNTIL}), b AS (SELECT *, coalesce(sum(CASE WHEN action IN ('complete', 'cancel') THEN 1 ELSE 0 END) OVER (PARTITION BY task ORDER BY sec, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, CAST(sum(CASE WHEN action = 'claim' THEN 1 ELSE 0 END) OVER (PARTITION BY task ORDER BY sec, id) AS BIGINT) AS attempts, lead(sec) OVER (PARTITION BY task ORDER BY sec, id) AS next FROM l), o AS (SELECT * FROM b WHERE before = 0)
    SELECT task, sec, CASE action WHEN 'complete' THEN 'completed' WHEN 'cancel' THEN 'canceled' WHEN 'add' THEN 'ready' ELSE 'in_progress' END AS status, action AS why, attempts FROM o
    UNION ALL SELECT task, sec + {_LEASE}, 'ready', 'lapsed', attempts FROM o WHERE action IN ('claim', 'extend') AND (next IS NULL OR next > sec + {_LEASE}) AND sec + {_LEASE} <= {_UNTIL} UNION ALL SELECT task, sec + 3600, '', 'pruned', attempts FROM o WHERE action IN ('complete', 'cancel') AND sec + 3600 <= {_UNTIL}""")
def st10_lease_log(murmurs):
    action = F.when(F.col("topic") == "signup", "claim").when(F.col("topic") == "purchase", "complete").when(F.col("topic") == "error", "cancel").when(F.col("topic") == "click", "extend").otherwise("add")
    return U.lease_log(murmurs.select(F.col("file").alias("task"), "sec", "id", action.alias("action")), _LEASE, _UNTIL)


@register("""WITH f AS (SELECT commit_id, path, CASE WHEN instr(path, '/') > 0 THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir FROM (SELECT commit_id, path FROM {diffs} UNION ALL SELECT commit_id, path FROM {file_revs} WHERE commit_id % 3 = 0)),
    g AS (SELECT commit_id, count(*) AS n, min(path) AS one, min(string_split(dir, '/')) AS lo, max(string_split(dir, '/')) AS hi FROM f GROUP BY 1), s AS (SELECT *, len(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda i: lo[1:i] = hi[1:i])) AS k FROM g)
    SELECT commit_id, n, CASE WHEN n = 1 THEN one WHEN k = 0 OR (k = 1 AND lo[1] = '') THEN 'these files' ELSE array_to_string(lo[1:k], '/') || '/' END AS area FROM s""")
def s210_common_area(diffs, file_revs):
    paths = diffs.select("commit_id", "path").unionByName(file_revs.filter("commit_id % 3 = 0").select("commit_id", "path"))
    return paths.groupBy("commit_id").agg(F.count("*").alias("n"), T.common_area("path").alias("area"))


_THOUGHT = "'a the <thinking>I really have to utilize the plan ' || seq || '. Then <b> the rest!</thinking> the <thinking>the only</thinking> end <x'"


@register(f"""SELECT session, seq, replace(replace({_THOUGHT}, '<thinking>I really have to utilize the plan ' || seq || '. Then <b> the rest!</thinking>', '<thinking>I must use plan ' || seq || '. Then <b> rest!</thinking>'), '<thinking>the only</thinking>', '<thinking>only</thinking>') AS words,
    'a the <thinking>I really have to utilize the plan ' || seq || '. ...[reasoning elided]</thinking> the <thinking>only</thinking> end <x' AS first_, 'a the  the  end <x' AS dropped FROM {{transcript}}""")
def s210_passages(transcript):
    text = F.concat(F.lit("a the <thinking>I really have to utilize the plan "), F.col("seq").cast("string"), F.lit(". Then <b> the rest!</thinking> the <thinking>the only</thinking> end <x"))
    thin = lambda mode: T.thinned(text, "thinking", mode, ("the", "really"), {"have to": "must", "utilize": "use"})
    return transcript.select("session", "seq", thin("words").alias("words"), thin("first").alias("first_"), thin("all").alias("dropped"))


@register("SELECT id, symbol_id, CAST(rank AS INTEGER) AS rank, CASE WHEN n = 1 THEN 'inferred' ELSE 'ambiguous' END AS confidence FROM (SELECT r.id, s.id AS symbol_id, count(*) OVER (PARTITION BY r.id, r.blob_id, ref_name) AS n, row_number() OVER (PARTITION BY r.id, r.blob_id, ref_name ORDER BY s.line, s.id) AS rank FROM {symbol_refs} r JOIN {symbols} s ON s.blob_id = r.blob_id AND s.name = ref_name) WHERE rank <= 8")
def snk1_bucketed(symbol_refs, symbols):
    """References and symbols written in buckets of their file, and joined there."""
    spark, name = symbols.sparkSession, uuid.uuid4().hex
    tables = [sinks.write_bucketed(t, f"weir_{k}_{name}", f"{shared_folder(spark)}/{k}-{name}") for k, t in (("refs", symbol_refs), ("symbols", symbols))]
    return D.resolve(*tables)


@register("SELECT number, CASE WHEN month(make_timestamp(created_at * 1000000)) % 2 = 0 THEN state ELSE 'old' END AS state, strftime(make_timestamp(created_at * 1000000), '%Y-%m') AS day FROM {pull_requests}")
def r24_written(pull_requests):
    """Pull requests written by month, then those of every second month again: these are replaced, the others stay."""
    path = f"{shared_folder(pull_requests.sparkSession)}/prs-{uuid.uuid4()}"
    rows = pull_requests.select("number", "state", "created_at")
    sinks.write_by_date(rows.withColumn("state", F.lit("old")), path, unit="yyyy-MM", spread=1)
    sinks.write_by_date(rows.filter(F.month(F.timestamp_seconds("created_at")) % 2 == 0), path, unit="yyyy-MM", spread=1)
    return pull_requests.sparkSession.read.parquet(path).select("number", "state", F.col("day").cast("string").alias("day"))


_FACT = "SELECT left(content, 40) AS headline, CASE WHEN id % 2 = 0 THEN lang END AS who, source AS source_type, 'doc ' || id AS source_ref FROM {ledger} WHERE content IS NOT NULL AND content <> ''"


@register(f"SELECT headline, NULL::VARCHAR AS summary, NULL::VARCHAR AS rationale, who, source_type, source_ref, NULL::VARCHAR AS source_url, NULL::VARCHAR AS source_title, NULL::VARCHAR AS timestamp, NULL::VARCHAR AS category FROM ({_FACT})")
def snk5_src12_facts(ledger):
    """Facts of the texts, written as lines of JSON and read again."""
    path = f"{shared_folder(ledger.sparkSession)}/facts-{uuid.uuid4()}"
    given = {"headline": F.substring("content", 1, 40), "who": F.when(F.col("id") % 2 == 0, F.col("lang")), "source_type": F.col("source"), "source_ref": F.concat(F.lit("doc "), F.col("id").cast("string"))}
    names = [c.split()[0] for c in io.FACT.split(", ")]
    io.write_facts(ledger.filter("content <> ''").select(*(given.get(n, F.lit(None).cast("string")).alias(n) for n in names)), path)
    return io.read_facts(ledger.sparkSession, path)


_MODEL = "CASE WHEN type = 'assistant' AND seq % 3 > 0 THEN 'm' || (seq % 5) WHEN type = 'assistant' THEN '' END"


@register(f"SELECT session, arg_max({_MODEL}, seq) AS model FROM {{transcript}} WHERE coalesce({_MODEL}, '') <> '' GROUP BY 1")
def r28_models(transcript):
    assistant, seq = F.col("type") == "assistant", F.col("seq")
    model = F.when(assistant & (seq % 3 > 0), F.concat(F.lit("m"), (seq % 5).cast("string"))).when(assistant, "")
    return foreign.models(transcript.select("session", "seq", seq.alias("created_at"), model.alias("model")))


@register("WITH n AS (SELECT session, max(seq) + 1 AS next FROM {transcript} GROUP BY 1) SELECT session, seq, type, next FROM {transcript} JOIN n USING (session) WHERE seq >= CASE WHEN session % 3 = 0 THEN 0 ELSE session % 4 END")
def r28_from_offsets(transcript):
    """Each session read on from an offset; every third has none."""
    offsets = transcript.filter("session % 3 <> 0").select("session", (F.col("session") % 4).alias("offset")).distinct()
    return foreign.from_offsets(transcript.select("session", "seq", "type"), offsets)


def st5_followed(spark, d):
    """The given conversations followed as a stream of files; the path is a pattern since a stream takes no single file."""
    path = f"{shared_folder(spark)}/tail-{uuid.uuid4()}"
    given = spark.read.parquet(f"{d}/conversations.parquet")
    rows = spark.readStream.schema(given.schema).parquet(f"{d}/conversations.parque[t]").select(F.col("conv_id").cast("long").alias("session"), F.col("turn").cast("long").alias("seq"), "role")
    tail.follow(rows, path, f"{path}/checkpoint").awaitTermination()
    return tail.followed(spark, path, "session long, seq long, role string").join(tail.offsets(spark, path).select("session", "offset"), "session").select("session", "seq", "role", "offset")


QUERIES["st5_followed"] = st5_followed
ORACLES["st5_followed"] = "SELECT conv_id AS session, CAST(turn AS BIGINT) AS seq, role, CAST(max(turn) OVER (PARTITION BY conv_id) + 1 AS BIGINT) AS offset FROM (SELECT DISTINCT ON (conv_id, turn) conv_id, turn, role FROM conversations ORDER BY conv_id, turn)"
