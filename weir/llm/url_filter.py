"""URL filter: rules first, else naive Bayes over segmented host names and path tokens.

Host labels are concatenated words; a unigram model of the pages' own words splits each by Viterbi.
A multinomial naive Bayes model then scores the words of host and path. The rules are its labels: it
learns from the distinct addresses that a rule decides what blocked and allowed ones are made of, and
so carries the rules over to addresses that none of them names.

All word counts stay in tables: the substrings of each distinct host meet the words of the pages, and
the words of each distinct address meet their counts there, so no word is left out for being rare
among many. (A run of letters that the pages have only once, at any size, is no word to split by; nor
is one of more than ``LABEL`` letters, since no part of a host name may be longer.) What is held in one
place is bounded: the words of one host or address, a Counter of at most ``MOST_HELD`` words in a task,
and the groups that ``join_groups`` broadcasts.

Defined cases: a null url or one without ``://`` has an empty host and path, no rule and the verdict
allow. Where the rules decide no page, or all in the same way, there is nothing to learn and all other
pages are allowed; a word that no decided address has counts for nothing. Rows are independent:
repeated rows get equal verdicts. Very long urls are split whole. Empty tables give no rows; extra
columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import join_groups, materialise, written

#: (action, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Bound of what a task counts before it passes that on.
MOST_HELD = 1 << 20
#: Fixed value: the longest part between two dots of a host name.
LABEL = 63
_RUN, _LETTERS = re.compile(r"[^\W\d_]+|\d+"), re.compile(r"[^\W\d_]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its action) of the longest rule that fits, or nulls."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


class Segmenter:
    """Viterbi split of a run of letters into the most likely words, of ``total`` occurrences in all."""

    def __init__(self, words: dict[str, int], total: int | None = None):
        self.total = max(1, sum(words.values()) if total is None else total)
        self.cost = {w: -math.log(n / self.total) for w, n in words.items()}
        self.longest = max(map(len, words), default=0)

    def split(self, s: str) -> tuple[str, ...]:
        """A piece that is no word costs as much as a word that occurs once, and 2.3 for each letter."""
        best, back = [0.0] + [math.inf] * len(s), [0] * (len(s) + 1)
        unknown, start = math.inf, 0  # the best place where a piece that is no word can start
        for j in range(1, len(s) + 1):
            if best[j - 1] - 2.3 * (j - 1) < unknown:
                unknown, start = best[j - 1] - 2.3 * (j - 1), j - 1
            best[j], back[j] = unknown + 2.3 * j + math.log(self.total), start
            for i in range(max(0, j - self.longest), j):
                if (cost := self.cost.get(s[i:j])) is not None and best[i] + cost <= best[j]:
                    best[j], back[j] = best[i] + cost, i
        out, j = [], len(s)
        while j:
            out.append(s[back[j] : j])
            j = back[j]
        return tuple(out[::-1])


def runs(host_: str) -> list[str]:
    """Runs of letters or of digits of a host without its last label."""
    return [run for label in host_.split(":")[0].split(".")[:-1] for run in _RUN.findall(label)]


def path_words(path_: str) -> list[str]:
    """Words of a path; numbers count as one word."""
    return ["/0" if run[0].isdigit() else "/" + run.lower() for run in _RUN.findall(path_)]


def untagged(html: str) -> str:
    """Without what stands from a < to the next >; a < without one stays, and is not looked for again and again."""
    end = html.rfind(">") + 1
    return re.sub(r"<[^>]*>", " ", html[:end]) + html[end:]


def word_counts(pages: DataFrame) -> DataFrame:
    """word, n: the words of all pages."""

    def run(batches):
        seen: Counter[str] = Counter()
        for b in batches:
            for html in b.column(0).to_pylist():
                seen.update(_LETTERS.findall(untagged((html or "").lower())))
                if len(seen) > MOST_HELD:  # bounded memory: what is counted so far goes on its way
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return pages.select("html").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _substrings(hosts: DataFrame) -> DataFrame:
    """id, word: the runs of at most ``LABEL`` letters inside each host (some twice in a very long one)."""

    def run(batches):
        for b in batches:
            ids: list[int] = []
            words: list[str] = []
            for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found: set[str] = set()
                for part in _LETTERS.findall(" ".join(runs(h))):
                    for i in range(len(part)):
                        found.update(part[i:j] for j in range(i + 1, min(len(part), i + LABEL) + 1))
                        if len(found) > 1 << 16:
                            yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int64()), pa.array(list(found))], ["id", "word"])
                            found.clear()
                ids += [k] * len(found)
                words += found
                if len(ids) > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], ["id", "word"])
                    ids, words = [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], ["id", "word"])

    return hosts.select("id", "h").mapInArrow(run, "id long, word string")


def split_hosts(hosts: DataFrame, pages: DataFrame) -> DataFrame:
    """``hosts`` (id, h, size) with own, the words of each."""
    kept = written(word_counts(pages).filter("n >= 2"))
    total = kept.agg(F.sum("n")).first()[0] or 0
    parts = _substrings(hosts)
    # Substrings that are no words stay in, so that the common ones are known as such.
    known = materialise(parts.groupBy("word").agg(F.count("*").alias("size")).join(kept, "word", "left"))
    met = join_groups(parts, known, "word", "size", known.agg(F.sum("size")).first()[0] or 0).filter("n is not null")
    met = met.groupBy("id").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("ns"))

    @F.pandas_udf("array<string>")
    def own(h: pd.Series, words: pd.Series, ns: pd.Series) -> pd.Series:
        out = []
        for x, w, n in zip(h, words, ns, strict=True):
            s = Segmenter({} if w is None else dict(zip(w, map(int, n), strict=True)), total)
            out.append([word for run in runs(x) for word in (("0",) if run[0].isdigit() else s.split(run))])
        return pd.Series(out, dtype=object)

    return materialise(hosts.join(met, "id", "left").select("id", "h", "size", own("h", "words", "ns").alias("own")))


def address(host_: Column, path_: Column) -> Column:
    """Host and path in one, numbers in the path as 0."""
    return F.concat(host_, F.regexp_replace(path_, r"[0-9]+", "0"))


def score(pages: DataFrame, rules=RULES) -> DataFrame:
    """at, pages, own, log_odds: each distinct address with a host, its pages, the words of its host and the log odds of blocked."""
    h, p = host(F.col("url")), path(F.col("url"))
    action = rule(h, p, rules)[1]
    urls = pages.select(h.alias("h"), address(h, p).alias("at"), action.alias("action")).filter("h <> ''").groupBy("h", "at")
    urls = urls.agg(F.count("*").alias("pages"), F.count_if(F.col("action") == "block").alias("blocked"), F.count_if(F.col("action") == "allow").alias("allowed"))
    urls = materialise(urls.withColumn("id", F.monotonically_increasing_id()))
    hosts = materialise(urls.groupBy("h").agg(F.count("*").alias("size")).withColumn("id", F.monotonically_increasing_id()))
    hosts = split_hosts(hosts, pages)

    @F.pandas_udf("array<string>")
    def rest(x: pd.Series) -> pd.Series:
        return pd.Series([path_words(p) for p in x], dtype=object)

    own = join_groups(urls, hosts.select("h", "size", "own"), "h", "size", urls.count())
    bad, good = F.col("blocked") > F.col("allowed"), F.col("allowed") > F.col("blocked")
    own = materialise(own.select("id", "at", "pages", "own", rest(F.expr("substring(at, length(h) + 1)")).alias("rest"), bad.alias("bad"), good.alias("good")))
    words = own.select("id", "bad", "good", F.posexplode(F.concat("own", "rest")).alias("pos", "word"))
    both = F.count_if("bad").alias("bad"), F.count_if("good").alias("good")
    counts = materialise(words.groupBy("word").agg(*both, F.count("*").alias("size")))
    urls_of = own.agg(*both).first()
    words_of = counts.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.count_if(F.expr("bad + good > 0")).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    if not urls_of.bad or not urls_of.good:
        return own.select("at", "pages", "own", F.lit(-math.inf).alias("log_odds"))
    prior = math.log(urls_of.bad / urls_of.good)
    log = lambda c, total: F.log((F.col(c) + 1) / F.lit(float(total + words_of.n)))
    weight = F.when(F.expr("bad + good > 0"), log("bad", words_of.bad) - log("good", words_of.good)).otherwise(0.0)
    weights = counts.select("word", "size", weight.alias("weight"))
    met = join_groups(words.select("id", "pos", "word"), weights, "word", "size", words_of.size).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "weight"))).alias("w"))
    sums = met.select("id", F.aggregate("w", F.lit(0.0), lambda acc, x: acc + x["weight"]).alias("s"))  # in one order, so that it is the same in each run
    return materialise(own.join(sums, "id", "left").select("at", "pages", "own", (F.lit(prior) + F.coalesce("s", F.lit(0.0))).alias("log_odds")))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, host_words, log_odds."""
    found = score(pages, rules)
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("at", address(F.col("host"), F.col("path")))
    known = join_groups(rows.filter("host <> ''"), found, "at", "pages", found.agg(F.sum("pages")).first()[0] or 0).select("page_id", "host", "path", "own", "log_odds")
    empty = rows.filter("host = ''").select("page_id", "host", "path", F.array().cast("array<string>").alias("own"), F.lit(-math.inf).alias("log_odds"))
    rows = known.unionByName(empty)
    name, action = rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("log_odds") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce(action, method).alias("verdict"), F.col("own").alias("host_words"), "log_odds")
