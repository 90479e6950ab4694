"""Ranking and comparing of texts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weir.functions import text as T
from weir.tables import materialise


def ranked(docs: DataFrame, terms: list[str], k: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Texts with any of the terms, by BM25 over lower-cased words.

    A row of counts for each text is written once, summed and scored; the driver gets one row of totals
    (as many numbers as there are terms).
    """
    w = F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9_]+"), F.lit(0))
    rows = docs.select("id", w.alias("w"))
    count = lambda term: F.size(F.filter("w", lambda x: x == term))
    rows = materialise(rows.select("id", F.size("w").alias("len"), *(count(t).alias(f"t{i}") for i, t in enumerate(terms))))
    total = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *(F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms)))).first()
    tf = [F.col(f"t{i}") for i in range(len(terms))]
    idf = [F.log(1 + (F.lit(total.n) - total[f"d{i}"] + 0.5) / (total[f"d{i}"] + 0.5)) for i in range(len(terms))]
    share = F.col("len") / (total["mean"] or 1.0)
    score = reduce(lambda x, y: x + y, [g * f * (k1 + 1) / (f + k1 * (1 - b + b * share)) for f, g in zip(tf, idf, strict=True)], F.lit(0.0))
    hit = reduce(lambda x, y: x | y, [f > 0 for f in tf], F.lit(False))
    return rows.filter(hit).select("id", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def located(docs: DataFrame, terms: list[str], most: int = 120) -> DataFrame:
    """The line (from 1) with the earliest of the terms, any case, and its text, at most ``most`` characters.

    The place is looked for in the text itself, since lower-casing may change its length.
    """
    before = F.regexp_extract("content", "(?isu)^(.*?)(?:" + "|".join(re.escape(t) for t in terms) + ")", 1)
    any_ = F.col("content").rlike("(?iu)(?:" + "|".join(re.escape(t) for t in terms) + ")")
    rows = docs.filter(any_).withColumn("line", 1 + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))))
    return rows.select("id", "line", F.substring(F.trim(F.element_at(F.split("content", "\n"), F.col("line"))), 1, most).alias("snippet"))


def answers(t: DataFrame) -> DataFrame:
    """Each user entry (ref) with the assistant's entry right after it (cand)."""
    by = W.partitionBy("session").orderBy("seq")
    rows = t.withColumns({"next": F.lead("type").over(by), "cand": F.lead("content").over(by)})
    return rows.filter("type = 'user' and next = 'assistant'").select("session", "seq", F.coalesce("content", F.lit("")).alias("ref"), F.coalesce("cand", F.lit("")).alias("cand"))


def summary_score(ref: Column, cand: Column) -> Column:
    """Jaccard of the word sets, lowered where the candidate is much shorter or longer; 1 if both are empty."""
    a, b = T.word_set(ref), T.word_set(cand)
    ratio = F.size(b) / F.size(a)
    score = T.jaccard(a, b) * F.when(ratio < 0.3, 0.5).when(ratio > 3.0, 0.8).otherwise(1.0)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(score)


def bullet_score(ref: Column, cand: Column, least: float = 0.3) -> Column:
    """F1 of bullets (arrays of texts): one is matched if a bullet of the other side has at least that Jaccard."""
    r, c = F.transform(ref, T.word_set), F.transform(cand, T.word_set)
    matched = lambda x, y: F.size(F.filter(x, lambda p: F.exists(y, lambda q: T.jaccard(p, q) >= least))) / F.size(x)
    recall, precision = matched(r, c), matched(c, r)
    return F.when((F.size(ref) == 0) & (F.size(cand) == 0), 1.0).when((F.size(ref) == 0) | (F.size(cand) == 0), 0.0).when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)


def moments_score(n_ref: Column, n_cand: Column, types_ref: Column, types_cand: Column) -> Column:
    """Of marked moments: how near the two counts are (0.6), and the Jaccard of their types (0.4)."""
    near = 1 - F.abs(n_ref - n_cand) / F.greatest(n_ref, n_cand)
    score = 0.6 * near + 0.4 * T.jaccard(types_ref, types_cand)
    return F.when((n_ref == 0) & (n_cand == 0), 1.0).when(n_ref == 0, 0.5).when(n_cand == 0, 0.0).otherwise(score)


def doc_score(text: Column, terms: list[str], weight: float = 0.85) -> Column:
    """Half the weight and the share of words that are among the terms; null without any."""
    w = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))
    counts = T.bound(w, lambda w: F.struct(F.size(F.filter(w, lambda x: x.isin(*terms))).alias("hits"), F.size(w).alias("all")))
    return T.bound(counts, lambda c: F.when(c["hits"] > 0, weight * (0.5 + c["hits"] / c["all"])))


def excerpts(docs: DataFrame, term: str, size: int = 160) -> DataFrame:
    """id and snippet of the texts that have the term, any case: about ``size`` characters around the first, in whole words; "..." where text was left out."""
    c, space, n = F.col("content"), r"[ \t\r\n]", F.length("content")
    at = 1 + F.length(F.regexp_extract(c, f"(?isu)^(.*?){re.escape(term)}", 1))
    lo = F.greatest(F.lit(1), at - size // 2)
    rows = docs.filter(F.contains(F.lower(c), F.lit(term.lower()))).select("id", "content", lo.alias("lo"), F.least(n, lo + size - 1).alias("hi"), n.alias("n"))
    part = F.substr(c, F.col("lo"), F.col("hi") - F.col("lo") + 1)
    part = F.when(F.col("lo") > 1, F.regexp_replace(part, f"^[^ \\t\\r\\n]*{space}+", "")).otherwise(part)
    part = F.when(F.col("hi") < F.col("n"), F.regexp_replace(part, f"{space}+[^ \\t\\r\\n]*\\z", "")).otherwise(part)
    dots = lambda cut: F.when(cut, "...").otherwise("")
    return rows.select("id", F.concat(dots(F.col("lo") > 1), F.trim(F.regexp_replace(part, f"{space}+", " ")), dots(F.col("hi") < F.col("n"))).alias("snippet"))


def collapse(t: DataFrame, skip: str = "system") -> DataFrame:
    """Runs of equal entries as one with its length; entries of type ``skip`` are left out and don't end a run."""
    by = W.partitionBy("session").orderBy("seq")
    rows = t.filter(F.col("type") != skip).withColumn("key", F.struct("type", F.sha2(F.coalesce("content", F.lit("")), 256)))
    rows = rows.withColumn("start", (~F.col("key").eqNullSafe(F.lag("key").over(by))).cast("int")).withColumn("run", F.sum("start").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("session", "run").agg(F.min("seq").alias("first"), F.count("*").alias("n"))


def speakers(t: DataFrame) -> DataFrame:
    """Who speaks in each session, in order of their first entry."""
    g = t.groupBy("session", "type").agg(F.min("seq").alias("first"))
    return g.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "type"))), lambda x: x["type"]), ",").alias("speakers"))
