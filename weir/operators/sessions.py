"""Transcripts: blocks, chapters, repeats, low-value sessions; and the scoring of texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _by():
    return W.partitionBy("session").orderBy("seq")


def _so_far():
    return _by().rowsBetween(W.unboundedPreceding, 0)


def blocks(t: DataFrame) -> DataFrame:
    """Islands of entries of one type: first and last entry and size."""
    change = (F.coalesce(F.lag("type").over(_by()), F.lit("")) != F.col("type")).cast("int")
    rows = t.withColumn("change", change).withColumn("block", F.sum("change").over(_so_far()))
    return rows.groupBy("session", "block").agg(F.min("type").alias("type"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n"))


def chapters(t: DataFrame) -> DataFrame:
    """A chapter starts at each user entry."""
    rows = t.withColumn("chapter", F.sum((F.col("type") == "user").cast("int")).over(_so_far()))
    return rows.groupBy("session", "chapter").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n"))


def chapter_tools(t: DataFrame) -> DataFrame:
    """How many entries of each type a chapter has, by name."""
    rows = t.withColumn("chapter", F.sum((F.col("type") == "user").cast("int")).over(_so_far()))
    g = rows.groupBy("session", "chapter", "type").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda x: F.concat(x["type"], F.lit(":"), x["n"].cast("string"))), ",")
    return g.groupBy("session", "chapter").agg(F.min("first").alias("first"), F.max("last").alias("last"), told.alias("tools"))


def repeats(t: DataFrame) -> DataFrame:
    """Entries whose content came before in the session, with the first place of it."""
    first = F.min("seq").over(W.partitionBy("session", F.sha2("content", 256)))
    return t.withColumn("first_seq", first).filter("seq > first_seq").select("session", "seq", "first_seq")


def low_value(t: DataFrame, least_chars: int = 80) -> DataFrame:
    g = t.groupBy("session").agg(F.count("*").alias("n"), F.sum((F.col("type") == "assistant").cast("long")).alias("answers"), F.coalesce(F.sum(F.when(F.col("type") == "user", F.length("content"))), F.lit(0)).alias("user_chars"))
    return g.withColumn("low_value", (F.col("n") < 2) | (F.col("answers") == 0) | (F.col("user_chars") < least_chars))


def tokens(t: DataFrame) -> DataFrame:
    """Estimated tokens by type: bytes / 4, at least 1, 0 if empty."""
    size = F.octet_length("content")
    return t.groupBy("type").agg(F.sum(F.when(size > 0, F.greatest(F.lit(1), F.floor(size / 4))).otherwise(0)).cast("long").alias("tokens"), F.count("*").alias("n"))


def occurrences(text, term: str):
    """How often ``term`` occurs without overlap."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term))


def ledger_search(docs: DataFrame, query: str, k: int = 20) -> DataFrame:
    """Texts that hold all terms, any case; scored 0.5 plus up to 0.5 by counts of at most 10 a term."""
    terms = list(dict.fromkeys(re.findall(r"[a-z0-9_-]+", query.lower())))
    low = F.lower("content")
    rows = docs.withColumn("low", low).filter(" and ".join(f"contains(low, '{t}')" for t in terms) or "false")
    total = sum((F.least(F.lit(10), occurrences(F.col("low"), t)) for t in terms), F.lit(0))
    score = F.round(0.5 + F.least(F.lit(0.5), total / 100), 6)
    return rows.select("id", "source", score.alias("score")).orderBy(F.desc("score"), F.desc("id")).limit(k)


def keywords(docs: DataFrame, stop: frozenset[str], k: int = 8) -> DataFrame:
    """The most frequent words of three letters or more of each source."""
    w = docs.select("source", F.explode(F.regexp_extract_all(F.lower("content"), F.lit("[a-z]{3,}"), 0)).alias("word")).filter(~F.col("word").isin(sorted(stop)))
    g = w.groupBy("source", "word").agg(F.count("*").alias("n"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= k)


def redact(t: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Ordered rules (keyword, Java regular expression, replacement); the keyword guards the expression."""
    c = F.col("content")
    for word, pattern, slug in rules:
        c = F.when(F.contains(F.lower(c), F.lit(word)), F.regexp_replace(c, pattern, slug)).otherwise(c)
    return t.withColumn("redacted", c)
