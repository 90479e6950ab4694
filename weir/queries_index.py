"""Queries over the written full-text index."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.operators import inverted as I
from weir.registry import register

_INDEX = """w AS (SELECT id, regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9_]+') AS w FROM {ledger}), n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
    p AS (SELECT w.id, len(w.w) AS len, t.term, len(list_filter(w.w, lambda x: x = t.term)) AS tf FROM w, (SELECT unnest(%s) AS term) t), f AS (SELECT term, count(*) AS df FROM p WHERE tf > 0 GROUP BY 1),
    s AS (SELECT id, round(sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 4) AS score, count(*) AS met FROM p JOIN f USING (term), n WHERE tf > 0 GROUP BY id)"""


@register(f"WITH {_INDEX % "['the', 'und', 'que', 'con']"} SELECT id, score FROM s ORDER BY score DESC, id LIMIT 50")
def f1_indexed(ledger):
    return I.ranked(I.build(ledger), ["the", "und", "que", "con"], 50)


@register("""WITH w AS (SELECT id, regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9_]+') AS w FROM {ledger}), p AS (SELECT id, list_filter(range(1, len(w)), lambda i: w[i] = 'in' AND w[i + 1] = 'the') AS places FROM w WHERE len(w) > 1)
    SELECT id, CAST(len(places) AS BIGINT) AS hits, CAST(places[1] AS INTEGER) AS first FROM p WHERE len(places) > 0""")
def f1_phrase(ledger):
    return I.phrase(I.build(ledger), "In the")


@register(f"WITH {_INDEX % "['the', 'und']"} SELECT id, source, lang, score, length(content) AS n_chars FROM s JOIN {{ledger}} l USING (id) WHERE met = 2")
def j20_hits(ledger):
    return I.hits(I.build(ledger), ["the", "und"], ledger.select("id", "source", "lang", F.length("content").alias("n_chars")), every=True)


@register(f"WITH {_INDEX % "['the', 'con']"} SELECT id, score FROM s WHERE id IN (SELECT id FROM {{ledger}} WHERE lang <> 'en' AND source <> 'src0') ORDER BY score DESC, id LIMIT 50")
def u6_filtered(ledger):
    return I.filtered(I.build(ledger), ["the", "con"], ledger.filter("lang <> 'en' and source <> 'src0'"), 50)
