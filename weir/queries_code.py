"""Queries on symbols, references, files, spans and change logs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weir.functions import code as L
from weir.operators import activity as A
from weir.operators import code as D
from weir.operators import collaboration as C
from weir.operators import search as Q
from weir.registry import register

SINCE, UNTIL = 1704067200 + 3 * 86400, 1704067200 + 12 * 86400
QUIET = 6 * 3600
CHANGES = {"signup": "created", "purchase": "deleted", "click": "modified", "view": "modified", "error": "renamed"}
STATES = {"signup": "open", "purchase": "closed", "click": "in_progress", "view": "open", "error": "blocked"}
_case = lambda m: "CASE topic " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"
_map = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))[F.col("topic")]
_TIPS = "SELECT DISTINCT path, blob_id FROM {{file_revs}} WHERE commit_id IN (SELECT commit_id FROM {{refs}} WHERE name IN ({}))"


@register("SELECT DISTINCT path, line, s.name, kind, language FROM {symbols} s JOIN {blobs} b ON b.id = s.blob_id JOIN (" + _TIPS.format("'refs/heads/dev'").replace("{{", "{").replace("}}", "}") + ") t ON t.blob_id = s.blob_id WHERE regexp_matches(lower(s.name), '^f1.*$') AND contains(lower(return_type), 'error') AND kind IN ('function', 'method') AND language = 'go' ORDER BY path, line, s.name, kind LIMIT 200")
def ql_symbol(symbols, blobs, file_revs, refs):
    return Q.search_symbols(symbols, blobs, file_revs, refs, ["f1*"], returns="error", lang="go", rev="dev", limit=200)


@register("SELECT DISTINCT path, line, s.name, kind, language FROM {symbols} s JOIN {blobs} b ON b.id = s.blob_id JOIN (" + _TIPS.format("'refs/heads/main', 'refs/heads/master'").replace("{{", "{").replace("}}", "}") + ") t ON t.blob_id = s.blob_id WHERE contains(lower(s.name), 'f2') AND NOT contains(lower(path), 'src/3') ORDER BY path, line, s.name, kind LIMIT 100")
def ql_symbol_file(symbols, blobs, file_revs, refs):
    return Q.search_symbols(symbols, blobs, file_revs, refs, ["f2"], not_file="src/3", limit=100)


_CALLS = "SELECT src_symbol_id AS src, dst_symbol_id AS dst, dst_name FROM {symbol_edges} WHERE kind = 'call' AND confidence IN ('extracted', 'inferred')"
_AT = "JOIN {symbols} s ON s.id = node JOIN (" + _TIPS.format("'refs/heads/main', 'refs/heads/master'").replace("{{", "{").replace("}}", "}") + ") t ON t.blob_id = s.blob_id"


@register(f"RECURSIVE WITH e AS ({_CALLS}), r(node, depth) AS (SELECT DISTINCT src, 1 FROM e JOIN {{symbols}} f ON f.id = src AND f.kind = 'function' WHERE contains(dst_name, 'f17') UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 3) SELECT DISTINCT path, name, kind, depth FROM r {_AT} ORDER BY depth, path, name, kind LIMIT 5000")
def j17_edge_callers(symbol_edges, symbols, file_revs, refs):
    return Q.callers(symbol_edges, symbols, file_revs, refs, "f17", confidence="inferred", depth=3, limit=5000)


@register(f"RECURSIVE WITH e AS ({_CALLS}), r(node, depth) AS (SELECT DISTINCT dst, 1 FROM e JOIN {{symbols}} f ON f.id = src AND f.kind = 'function' WHERE contains(f.name, 'f17') UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 3) SELECT DISTINCT path, name, kind, depth FROM r {_AT} ORDER BY depth, path, name, kind LIMIT 5000")
def j17_edge_callees(symbol_edges, symbols, file_revs, refs):
    return Q.callees(symbol_edges, symbols, file_revs, refs, "f17", confidence="inferred", depth=3, limit=5000)


@register(f"SELECT DISTINCT path, name, s.kind, 1 AS depth FROM (SELECT DISTINCT src_symbol_id AS node FROM {{symbol_edges}} e JOIN {{symbols}} f ON f.id = src_symbol_id AND f.kind = 'function' WHERE e.kind = 'call' AND confidence = 'extracted' AND contains(dst_name, 'f7')) {_AT} ORDER BY depth, path, name, s.kind LIMIT 500")
def j19_one_hop_callers(symbol_edges, symbols, file_revs, refs):
    return Q.callers(symbol_edges, symbols, file_revs, refs, "f7", confidence="extracted", limit=500)


@register(f"SELECT DISTINCT path, s.name, s.kind, 1 AS depth FROM (SELECT DISTINCT dst_symbol_id AS node FROM {{symbol_edges}} e JOIN {{symbols}} f ON f.id = src_symbol_id AND f.kind = 'function' WHERE e.kind = 'call' AND contains(f.name, 'f42')) {_AT} ORDER BY depth, path, s.name, s.kind LIMIT 500")
def j19_one_hop_callees(symbol_edges, symbols, file_revs, refs):
    return Q.callees(symbol_edges, symbols, file_revs, refs, "f42", limit=500)


@register("SELECT r.id, r.blob_id, r.line, arg_min(s.id, (s.end_line - s.line, s.line, s.id)) AS symbol_id FROM {symbol_refs} r LEFT JOIN {symbols} s ON s.blob_id = r.blob_id AND r.line >= s.line AND r.line < s.end_line GROUP BY 1, 2, 3")
def j12_innermost(symbol_refs, symbols):
    return D.innermost(symbol_refs, symbols)


@register("SELECT s.id, s.blob_id, s.line, s.end_line, arg_min(p.id, (p.end_line - p.line, p.line, p.id)) AS parent_id FROM {symbols} s LEFT JOIN {symbols} p ON p.blob_id = s.blob_id AND p.line <= s.line AND p.end_line >= s.end_line AND p.end_line - p.line > s.end_line - s.line GROUP BY 1, 2, 3, 4")
def j13_parents(symbols):
    return D.parents(symbols)


@register("SELECT id, symbol_id, CAST(rank AS INTEGER) AS rank, CASE WHEN n = 1 THEN 'inferred' ELSE 'ambiguous' END AS confidence FROM (SELECT r.id, s.id AS symbol_id, count(*) OVER (PARTITION BY r.id, r.blob_id, ref_name) AS n, row_number() OVER (PARTITION BY r.id, r.blob_id, ref_name ORDER BY s.line, s.id) AS rank FROM {symbol_refs} r JOIN {symbols} s ON s.blob_id = r.blob_id AND s.name = ref_name) WHERE rank <= 8")
def j14_resolve(symbol_refs, symbols):
    return D.resolve(symbol_refs, symbols)


@register("SELECT DISTINCT name, kind, blob_id, line FROM {symbols} s WHERE kind IN ('function', 'method') AND EXISTS (SELECT 1 FROM {symbol_refs} r WHERE r.blob_id = s.blob_id AND ref_name = 'f7' AND r.line >= s.line AND r.line < s.end_line)")
def j18_callers(symbol_refs, symbols):
    return D.callers(symbol_refs, symbols, "f7")


@register("SELECT DISTINCT ref_name, blob_id FROM {symbol_refs} r WHERE EXISTS (SELECT 1 FROM {symbols} s WHERE s.blob_id = r.blob_id AND s.name = 'f7' AND kind IN ('function', 'method') AND r.line >= s.line AND r.line < s.end_line)")
def j19_callees(symbol_refs, symbols):
    return D.callees(symbol_refs, symbols, "f7")


@register("SELECT id, language FROM {blobs} b WHERE NOT EXISTS (SELECT 1 FROM {file_revs} f JOIN {refs} r ON r.commit_id = f.commit_id WHERE f.blob_id = b.id AND r.name = 'refs/heads/dev')")
def j22_orphans(blobs, file_revs, refs):
    return D.orphans(blobs, file_revs.join(refs.filter("name = 'refs/heads/dev'").select("commit_id"), "commit_id", "left_semi"))


@register("SELECT commit_id, path FROM {diffs} d WHERE commit_id IN (SELECT id FROM {commits} c WHERE timestamp < 893462400 AND NOT EXISTS (SELECT 1 FROM {pr_commits} p WHERE p.sha = c.hash))")
def j22_stale_diffs(diffs, commits, pr_commits):
    """Changes of old commits that no pull request has."""
    old = A.direct_commits(commits.filter("timestamp < 893462400"), pr_commits)
    return diffs.join(old.select(F.col("id").alias("commit_id")), "commit_id", "left_semi")


@register("SELECT pr_id AS number, path FROM {pr_comments} WHERE path IS NOT NULL UNION SELECT pr_id, path FROM {pr_commits} p JOIN {commits} c ON c.hash = p.sha JOIN {diffs} d ON d.commit_id = c.id UNION SELECT number, path FROM {pull_requests} p JOIN {diffs} d ON d.commit_id = p.id WHERE state = 'merged'")
def j24_u1_collisions(pull_requests, pr_comments, pr_commits, commits, diffs):
    return D.collisions(pull_requests, pr_comments, pr_commits, commits, diffs)


@register("SELECT path, count(*) AS n FROM {file_revs} WHERE path = 'src/1/p8.go' OR starts_with(path, 'src/2/') OR ends_with(path, '/p3.go') GROUP BY 1")
def j25_same_path(file_revs):
    return file_revs.filter(D.same_path(F.col("path"), ["src/1/p8.go", "src/2", "p3.go"])).groupBy("path").agg(F.count("*").alias("n"))


@register("SELECT r.repo_id, count(DISTINCT c.id) AS commits, count(DISTINCT f.blob_id) AS blobs FROM (SELECT DISTINCT repo_id FROM {refs}) r LEFT JOIN {commits} c ON c.repo_id = r.repo_id LEFT JOIN {file_revs} f ON f.commit_id = c.id GROUP BY 1")
def j31_repo_sizes(refs, commits, file_revs):
    return D.repo_sizes(refs, commits, file_revs)


@register("SELECT s.trace, s.span, CASE WHEN s.parent IS NULL THEN '<root>' ELSE coalesce(p.name, '<detached>') END AS under FROM (SELECT author AS trace, id AS span, CASE WHEN id % 11 > 0 THEN id - 1 - id % 5 END AS parent FROM {murmurs}) s LEFT JOIN (SELECT author AS trace, id AS span, topic AS name FROM {murmurs}) p ON p.trace = s.trace AND p.span = s.parent")
def j32_span_tree(murmurs):
    parent = F.when(F.col("id") % 11 > 0, F.col("id") - 1 - F.col("id") % 5)
    return D.span_tree(murmurs.select(F.col("author").alias("trace"), F.col("id").alias("span"), parent.alias("parent"), F.col("topic").alias("name")))


@register("SELECT name, n FROM (SELECT 'commits' AS name, count(*) AS n FROM {commits} UNION ALL SELECT 'diffs', count(*) FROM {diffs} UNION ALL SELECT 'symbols', count(*) FROM {symbols})")
def a22_row_counts(commits, diffs, symbols):
    a, b, c = (t.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, t in (("commits", commits), ("diffs", diffs), ("symbols", symbols)))
    return a.unionByName(b).unionByName(c)


@register("SELECT topic AS command, count(*) AS n, count(*) FILTER (WHERE value > 90) AS errors, round(sum(value), 3) AS total, min(sec) AS first, max(sec) AS last FROM {murmurs} GROUP BY 1")
def a23_telemetry(murmurs):
    return murmurs.groupBy(F.col("topic").alias("command")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 90).alias("errors"), F.round(F.sum("value"), 3).alias("total"), F.min("sec").alias("first"), F.max("sec").alias("last"))


@register("WITH c AS (SELECT file, string_agg(DISTINCT author, ',' ORDER BY author) AS authors, count(DISTINCT author) AS n FROM {murmurs} WHERE topic = 'click' GROUP BY 1 HAVING count(DISTINCT author) >= 2) SELECT authors, count(*) AS n_files, max(n) AS people, string_agg(file, ',' ORDER BY file) AS files, CASE WHEN max(n) >= 3 OR count(*) >= 3 THEN 'high' ELSE 'medium' END AS risk FROM c GROUP BY 1")
def a38_author_sets(murmurs):
    return D.by_author_set(C.conflicts(murmurs.filter("topic = 'click'")))


@register("SELECT *, CAST(row_number() OVER (PARTITION BY document ORDER BY seen, label, host) AS INTEGER) AS number FROM (SELECT document, host, min(seen) AS seen, arg_min(label, (seen, label)) AS label FROM {links} GROUP BY 1, 2)")
def a34_citations(links):
    return D.citations(links)


@register("WITH e AS (SELECT *, lag(topic) OVER (PARTITION BY author ORDER BY sec, id) AS before FROM {murmurs} WHERE topic IN ('signup', 'purchase')), k AS (SELECT *, lead(sec) OVER (PARTITION BY author ORDER BY sec, id) AS until FROM e WHERE topic <> coalesce(before, 'purchase')) SELECT author, id, sec AS start, until AS \"end\" FROM k WHERE topic = 'signup'")
def w5_pauses(murmurs):
    return D.pauses(murmurs, "signup", "purchase")


@register("WITH e AS (SELECT author, sec, id, value, CASE topic WHEN 'purchase' THEN 'user' WHEN 'signup' THEN 'assistant' ELSE 'work' END AS kind FROM {murmurs}), b AS (SELECT *, kind = 'work' OR coalesce(kind = 'assistant' AND value < 60 AND lag(kind) OVER w = 'work' AND lead(kind) OVER w = 'work', false) AS work FROM e WINDOW w AS (PARTITION BY author ORDER BY sec, id)), s AS (SELECT *, CASE WHEN work AND NOT coalesce(lag(work) OVER w, false) THEN 1 ELSE 0 END AS start FROM b WINDOW w AS (PARTITION BY author ORDER BY sec, id)), k AS (SELECT *, CAST(sum(start) OVER (PARTITION BY author ORDER BY sec, id) AS BIGINT) AS block FROM s) SELECT author, block, min(sec) AS first, max(sec) AS last, count(*) AS n FROM k WHERE work GROUP BY 1, 2")
def w11_work_blocks(murmurs):
    kind = F.when(F.col("topic") == "purchase", "user").when(F.col("topic") == "signup", "assistant").otherwise("work")
    return D.work_blocks(murmurs.select("author", "sec", "id", kind.alias("kind"), F.col("value").alias("size")), 60)


@register("SELECT author, id, CASE WHEN next = 'view' THEN next_id END AS result FROM (SELECT *, lead(topic) OVER w AS next, lead(id) OVER w AS next_id FROM {murmurs} WINDOW w AS (PARTITION BY author ORDER BY sec, id)) WHERE topic = 'click'")
def w12_paired(murmurs):
    return D.paired(murmurs, "click", "view")


@register(f"""WITH c AS (SELECT file AS path, sec, id, {_case(CHANGES)} AS change FROM {{murmurs}}), s AS (SELECT *, CASE WHEN coalesce(sec - lag(sec) OVER (PARTITION BY path ORDER BY sec, id), {QUIET}) >= {QUIET} THEN 1 ELSE 0 END AS start FROM c), b AS (SELECT *, CAST(sum(start) OVER (PARTITION BY path ORDER BY sec, id) AS BIGINT) AS burst FROM s),
    g AS (SELECT path, burst, max(sec) AS last, list_reduce(list(change ORDER BY sec, id), lambda a, x: CASE WHEN a = 'created' AND x = 'deleted' THEN '' WHEN a = 'created' AND x = 'modified' THEN 'created' WHEN a IN ('deleted', 'renamed') AND x = 'created' THEN 'modified' ELSE x END) AS change FROM b GROUP BY 1, 2) SELECT * FROM g WHERE change <> ''""")
def st3_settled(murmurs):
    return D.settle(murmurs.select(F.col("file").alias("path"), "sec", "id", _map(CHANGES).alias("change")), QUIET)


@register(f"SELECT file AS item, arg_max({_case(STATES)}, (sec, id)) AS status, arg_max(author, (sec, id)) AS author, min(sec) AS created, max(sec) AS updated, count(*) AS n FROM {{murmurs}} GROUP BY 1")
def r25_replay(murmurs):
    return D.replay(murmurs.select(F.col("file").alias("item"), "sec", "id", "author", _map(STATES).alias("status")))


@register(f"SELECT strftime(w, '%Y-%m-%d') AS week, n FROM (SELECT date_trunc('week', ts) AS w, count(*) AS n FROM {{murmurs}} GROUP BY 1) WHERE epoch(CAST(w AS TIMESTAMP)) < {UNTIL} AND epoch(CAST(w AS TIMESTAMP)) + 604800 > {SINCE}")
def j9_overlapping_weeks(murmurs):
    w = murmurs.groupBy(F.date_trunc("week", "ts").alias("w")).agg(F.count("*").alias("n"))
    start = F.unix_timestamp("w")
    return w.filter((start < UNTIL) & (start + 604800 > SINCE)).select(F.date_format("w", "yyyy-MM-dd").alias("week"), "n")


@register("SELECT number, state, CASE state WHEN 'open' THEN 0 WHEN 'merged' THEN 1 ELSE 2 END AS urgency, created_at FROM {pull_requests} ORDER BY urgency, created_at DESC, number LIMIT 100")
def o4_by_importance(pull_requests):
    urgency = F.when(F.col("state") == "open", 0).when(F.col("state") == "merged", 1).otherwise(2)
    return pull_requests.select("number", "state", urgency.alias("urgency"), "created_at").orderBy("urgency", F.desc("created_at"), "number").limit(100)


@register("SELECT file, topic, arg_max(id, (sec, id)) AS id, max(sec) AS sec FROM {murmurs} GROUP BY 1, 2")
def src4_latest(murmurs):
    """The latest snapshot of each (file, topic), as one aggregate that combines before its shuffle."""
    return murmurs.groupBy("file", "topic").agg(F.max_by("id", F.struct("sec", "id")).alias("id"), F.max("sec").alias("sec"))


_EXTENSIONS = ["go", "PY", "tar.gz", "", "rs", "Tsx"]


@register("SELECT blob_id, language, count(*) AS n FROM (SELECT blob_id, ['go', 'python', NULL, NULL, 'rust', 'tsx'][CAST(blob_id % 6 + 1 AS INTEGER)] AS language FROM {file_revs}) GROUP BY 1, 2")
def s210_languages(file_revs):
    ext = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("blob_id") % 6 + 1).cast("int"))
    path = F.concat(F.regexp_replace("path", r"\.go$", ""), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))
    return file_revs.groupBy("blob_id", L.language_of(path).alias("language")).agg(F.count("*").alias("n"))


_CLEAN = "trim(regexp_replace(left(content, 200), '[^a-zA-Z]+', ' ', 'g'))"


@register(f"""WITH c AS (SELECT id, lang, {_CLEAN} AS c, CAST(length({_CLEAN}) AS INTEGER) AS n FROM {{ledger}} WHERE content IS NOT NULL AND {_CLEAN} <> '') SELECT id || '.go' AS path, c AS text, 'line' AS kind, 1 AS line, 1 AS end_line, 30 AS col, 33 + n AS end_col FROM c WHERE id % 2 = 0 UNION ALL SELECT id || '.go', '* ' || c || chr(10) || 'more', 'doc', 2, 3, 1, 8 FROM c WHERE id % 2 = 0 UNION ALL SELECT id || '.go', 'end', 'doc', 3, 3, 17, 24 FROM c WHERE id % 2 = 0
    UNION ALL SELECT id || '.py', c, 'doc', 4, 4, 11, 14 + n FROM c WHERE id % 2 = 1 UNION ALL SELECT id || '.py', 'it''s "x"', 'line', 5, 5, 1, 11 FROM c WHERE id % 2 = 1""")
def s210_comments(ledger):
    """Comments of small sources made of the texts."""
    c = F.trim(F.regexp_replace(F.substring("content", 1, 200), "[^a-zA-Z]+", " "))
    go = F.concat(F.lit('u := "http://a" + `/* no */` // '), c, F.lit("\n/** "), c, F.lit("\nmore */ x = 'a' /// end"))
    py = F.concat(F.lit('s = """ # no\n'), c, F.lit("""\n\"""\nt = '#no' ## """), c, F.lit("""\n# it's "x"\n"""))
    even = F.col("id") % 2 == 0
    rows = ledger.filter(c != "").select(F.concat(F.col("id").cast("string"), F.when(even, ".go").otherwise(".py")).alias("path"), F.when(even, go).otherwise(py).alias("content"))
    return L.comments(rows.withColumn("language", L.language_of(F.col("path"))))


#: Language, what stands before the text, after it, what the comment's text has before and after it; (line, end_line, col, end_col) and, where the text's length counts, how often it counts in col and end_col.
_FAMILIES = [
    ("haskell", "x = 1 {- a {- ", "\n-} b -} y", "a {- ", "\n-} b", "block", 1, 2, 7, 8, 0), ("sql", "select '--' -- ", "", "", "", "line", 1, 1, 13, 16, 1), ("html", "<p>\n<!-- ", " --></p>", "", "", "block", 2, 2, 1, 10, 1),
    ("lua", "s = '--' --[[ ", " ]]", "", "", "block", 1, 1, 10, 18, 1), ("ocaml", "let a = \"(*\" (* ", " *)", "", "", "block", 1, 1, 14, 20, 1), ("erlang", "f() -> 1. % ", "\ng().", "", "", "line", 1, 1, 11, 13, 1), ("css", "a{} /** ", " */", "* ", "", "doc", 1, 1, 5, 12, 1),
]


def _text(s):
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@register(f"WITH c AS (SELECT id, {_CLEAN} AS c FROM {{ledger}} WHERE content IS NOT NULL AND {_CLEAN} <> '') " + " UNION ALL ".join(
    f"SELECT id || '.{language}' AS path, {_text(head)} || c || {_text(tail)} AS text, '{kind}' AS kind, {line} AS line, {end_line} AS end_line, {col} AS col, CAST({end_col} + {times} * length(c) AS INTEGER) AS end_col FROM c WHERE id % {len(_FAMILIES)} = {i}"
    for i, (language, _, _, head, tail, kind, line, end_line, col, end_col, times) in enumerate(_FAMILIES)))
def s210_comment_families(ledger):
    """Comments of small sources made of the texts, in languages of each family."""
    c = F.trim(F.regexp_replace(F.substring("content", 1, 200), "[^a-zA-Z]+", " "))
    pick = lambda k: F.element_at(F.array(*(F.lit(f[k]) for f in _FAMILIES)), (F.col("id") % len(_FAMILIES) + 1).cast("int"))
    rows = ledger.filter(c != "").select(F.concat(F.col("id").cast("string"), F.lit("."), pick(0)).alias("path"), pick(0).alias("language"), F.concat(pick(1), c, pick(2)).alias("content"))
    return L.comments(rows)


@register("""WITH c AS (SELECT author, sec // 86400 AS day, count(*) FILTER (WHERE topic = 'view') AS r, count(*) FILTER (WHERE topic = 'click') AS e, count(*) FILTER (WHERE topic IN ('error', 'purchase')) AS b, count(*) FILTER (WHERE topic = 'error') AS t FROM {murmurs} GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY day) AS n FROM c)
    SELECT author, day, CASE WHEN r + e + b = 0 THEN CASE WHEN n = 1 THEN 'Discussion' ELSE 'Turn ' || n END WHEN t > 0 AND t > b // 2 AND r < e AND e < b THEN 'Testing' WHEN r > 2 * e AND r > b THEN 'Exploration' WHEN e > r AND e > b THEN 'Implementation' WHEN b > r AND b > e THEN CASE WHEN t > b // 2 THEN 'Testing' ELSE 'Execution' END WHEN r > 0 AND e > 0 THEN 'Implementation' ELSE 'Turn ' || n END AS title FROM k""")
def s210_chapter_titles(murmurs):
    n = lambda *topics: F.count_if(F.col("topic").isin(*topics))
    g = murmurs.groupBy("author", F.floor(F.col("sec") / 86400).alias("day")).agg(n("view").alias("r"), n("click").alias("e"), n("error", "purchase").alias("b"), n("error").alias("t"))
    g = g.withColumn("n", F.row_number().over(W.partitionBy("author").orderBy("day")))
    return g.select("author", "day", L.chapter_title(*(F.col(c) for c in "nrebt")).alias("title"))
