"""Queries that rank, compare and reshape texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.functions import text as T
from weir.operators import texts as X
from weir.registry import register

_LOW = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_PAIRS = "SELECT session, seq, coalesce(content, '') AS ref, coalesce(cand, '') AS cand FROM (SELECT *, lead(type) OVER w AS next, lead(content) OVER w AS cand FROM {transcript} WINDOW w AS (PARTITION BY session ORDER BY seq)) WHERE type = 'user' AND next = 'assistant'"
_JAC = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) > 0 THEN len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) ELSE 0.0 END"


@register("""WITH w AS (SELECT id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS w FROM {ledger}), r AS (SELECT id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'und')) AS b FROM w),
    t AS (SELECT count(*) AS n, avg(n) AS mean, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM r)
    SELECT id, round(ln(1 + (t.n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * r.n / mean)) + ln(1 + (t.n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * r.n / mean)), 4) AS score FROM r, t WHERE a > 0 OR b > 0 ORDER BY score DESC, id LIMIT 50""")
def f1_full_text(ledger):
    return X.ranked(ledger, ["the", "und"], 50)


@register("""WITH a AS (SELECT *, least(nullif(instr(lower(content), 'that'), 0), nullif(instr(lower(content), 'con'), 0)) AS place FROM {ledger}), l AS (SELECT *, 1 + length(left(content, place - 1)) - length(replace(left(content, place - 1), chr(10), '')) AS line FROM a WHERE place IS NOT NULL)
    SELECT id, CAST(line AS INTEGER) AS line, left(trim(string_split(content, chr(10))[line]), 120) AS snippet FROM l""")
def f6_located(ledger):
    return X.located(ledger, ["That", "con"])


@register(f"""WITH p AS ({_PAIRS}), s AS (SELECT session, seq, list_distinct({_LOW.format("ref")}) AS a, list_distinct({_LOW.format("cand")}) AS b FROM p)
    SELECT session, seq, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE ({_JAC.format("a", "b")}) * CASE WHEN len(b) / len(a) < 0.3 THEN 0.5 WHEN len(b) / len(a) > 3.0 THEN 0.8 ELSE 1.0 END END, 6) AS score FROM s""")
def f9_summary_score(transcript):
    return X.answers(transcript).select("session", "seq", F.round(X.summary_score(F.col("ref"), F.col("cand")), 6).alias("score"))


@register(f"""WITH p AS ({_PAIRS}), s AS (SELECT session, seq, list_transform(string_split(ref, chr(10)), lambda x: list_distinct({_LOW.format("x")})) AS a, list_transform(string_split(cand, chr(10)), lambda x: list_distinct({_LOW.format("x")})) AS b FROM p),
    m AS (SELECT session, seq, len(list_filter(a, lambda p: len(list_filter(b, lambda q: ({_JAC.format("p", "q")}) >= 0.3)) > 0)) / len(a) AS r, len(list_filter(b, lambda p: len(list_filter(a, lambda q: ({_JAC.format("p", "q")}) >= 0.3)) > 0)) / len(b) AS c FROM s)
    SELECT session, seq, round(CASE WHEN r + c > 0 THEN 2 * r * c / (r + c) ELSE 0.0 END, 6) AS score FROM m""")
def f10_bullet_score(transcript):
    lines = lambda c: F.split(F.col(c), "\n")
    return X.answers(transcript).select("session", "seq", F.round(X.bullet_score(lines("ref"), lines("cand")), 6).alias("score"))


@register("WITH k AS (SELECT *, CASE WHEN lag(type || coalesce(content, '')) OVER (PARTITION BY session ORDER BY seq) IS DISTINCT FROM type || coalesce(content, '') THEN 1 ELSE 0 END AS start FROM {transcript} WHERE type <> 'system'), r AS (SELECT *, CAST(sum(start) OVER (PARTITION BY session ORDER BY seq) AS BIGINT) AS run FROM k) SELECT session, run, min(seq) AS first, count(*) AS n FROM r GROUP BY 1, 2")
def w8_collapse(transcript):
    return X.collapse(transcript)


@register("SELECT session, string_agg(type, ',' ORDER BY first, type) AS speakers FROM (SELECT session, type, min(seq) AS first FROM {transcript} GROUP BY 1, 2) GROUP BY 1")
def a36_speakers(transcript):
    return X.speakers(transcript)


@register(r"""SELECT session, seq, left(trim(regexp_replace(content, '[ \t\r\n]+', ' ', 'g')), 120) AS compact, CASE WHEN instr(content, chr(10)) > 0 THEN string_split(content, chr(10))[1] ELSE left(content, 72) END AS first_line,
    regexp_replace(regexp_replace(lower(content), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE WHEN regexp_extract(content, '(?s)^(.*?[.!?])[ \t\r\n]', 1) = '' THEN content ELSE regexp_extract(content, '(?s)^(.*?[.!?])[ \t\r\n]', 1) END AS sentence,
    array_to_string(regexp_split_to_array(trim(content), '[ \t\r\n]+')[1:12], ' ') AS words, CAST(CASE WHEN strlen(content) > 0 THEN greatest(1, strlen(content) // 4) ELSE 0 END AS BIGINT) AS tokens, left(sha256(content), 24) AS hash FROM {transcript}""")
def p17_scalars(transcript):
    c = F.col("content")
    return transcript.select("session", "seq", T.compact(c, 120).alias("compact"), T.first_line(c).alias("first_line"), T.slug(c).alias("slug"), T.first_sentence(c).alias("sentence"), T.words(c, 12).alias("words"), T.tokens(c).alias("tokens"), T.short_hash(c).alias("hash"))


@register("SELECT source, lang, sum(CASE WHEN strlen(content) > 0 THEN greatest(1, strlen(content) // 4) ELSE 0 END)::BIGINT AS tokens, CASE WHEN source = 'src0' THEN 0 WHEN source = 'src1' THEN 1 ELSE 2 END AS place FROM {ledger} GROUP BY source, lang")
def r14_context_budget(ledger):
    place = F.when(F.col("source") == "src0", 0).when(F.col("source") == "src1", 1).otherwise(2)
    return ledger.groupBy("source", "lang").agg(F.sum(T.tokens(F.col("content"))).alias("tokens")).withColumn("place", place)


@register(r"""WITH c AS (SELECT session, seq, left(trim(regexp_replace(content, '[ \t\r\n]+', ' ', 'g')), 500) AS c FROM {transcript}), l AS (SELECT *, list_transform(range(1, CAST(100 + seq * 10 + 1 AS BIGINT)), lambda x: 'l' || x) AS l, regexp_extract(left(c, 100), '(?s)^(.*)[ \t\n]', 1) AS at_ FROM c)
    SELECT session, seq, c || ' ' AS visible, 'a' || c || chr(10) || 'y' AS plain, array_to_string(CASE WHEN len(l) > 120 THEN list_concat(list_concat(l[1:40], ['... ' || (len(l) - 80) || ' lines ...']), l[len(l) - 39:len(l)]) ELSE l END, '|') AS head_tail, c AS untagged,
    CASE WHEN length(c) <= 100 THEN c WHEN length(at_) >= 80 THEN at_ ELSE left(c, 100) END AS cut, 'p' || seq || '/q' AS segments, CASE WHEN seq = 0 THEN 'just now' WHEN seq < 2 THEN '50m ago' ELSE (seq * 3000 // 3600) || 'h ago' END AS ago, greatest(0.0, least(1.0, CAST(seq AS DOUBLE) - 1.5)) AS clamped, round(CASE WHEN seq > 0 THEN 100.0 * session / seq ELSE 0.0 END, 6) AS percent, nfc_normalize(c || 'é') AS composed FROM l""")
def s210_scalars(transcript):
    c = F.substring(F.trim(F.regexp_replace("content", r"[ \t\r\n]+", " ")), 1, 500)
    lines = F.array_join(F.transform(F.sequence(F.lit(1), (F.lit(100) + F.col("seq") * 10).cast("int")), lambda x: F.concat(F.lit("l"), x.cast("string"))), "\n")
    return transcript.select(
        "session", "seq", T.visible(F.concat(c, F.lit("\u200b\u00a0"))).alias("visible"), T.plain(F.concat(F.lit("a\x1b[31m"), c, F.lit("\nx\ry"))).alias("plain"), F.replace(T.head_tail(lines), F.lit("\n"), F.lit("|")).alias("head_tail"),
        T.without_tags(F.concat(F.lit("<b>"), F.regexp_replace(c, "[<>]", ""), F.lit("</b><i"))).alias("untagged"), T.cut(c, 100).alias("cut"), T.segments(F.concat(F.lit("p"), F.col("seq").cast("string"), F.lit("/q/r/s"))).alias("segments"), T.ago(F.col("seq") * 3000).alias("ago"),
        T.clamped(F.col("seq").cast("double") - 1.5).alias("clamped"), F.round(T.percent(F.col("session"), F.col("seq")), 6).alias("percent"), T.composed(F.concat(c, F.lit("e\u0301"))).alias("composed"))
