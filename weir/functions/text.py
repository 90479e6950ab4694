"""Scalar functions on text, as columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zero-width characters, and the no-break space that becomes a space.
ZERO_WIDTH = "[​‌‍⁠﻿]"
NBSP = " "


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` has it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def compact(c: Column, most: int) -> Column:
    """Runs of white space as one space, trimmed, at most ``most`` characters."""
    return F.substring(F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " ")), 1, most)


def first_line(c: Column, most: int = 72) -> Column:
    """Up to the first line break; without one the first ``most`` characters."""
    return F.when(F.instr(c, "\n") > 0, F.substring_index(c, "\n", 1)).otherwise(F.substring(c, 1, most))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def first_sentence(c: Column) -> Column:
    """Up to the first full stop, question or exclamation mark before white space; else everything."""
    found = F.regexp_extract(c, r"(?s)^(.*?[.!?])[ \t\r\n]", 1)
    return F.when(found == "", c).otherwise(found)


def visible(c: Column) -> Column:
    """Without zero-width characters, no-break spaces as spaces."""
    return F.translate(F.regexp_replace(c, ZERO_WIDTH, ""), NBSP, " ")


def plain(c: Column) -> Column:
    """Without terminal colour codes, and of each line only what follows its last carriage return."""
    return F.regexp_replace(F.regexp_replace(c, "\x1b\\[[0-9;]*[A-Za-z]", ""), "(?m)^[^\n]*\r([^\r\n])", "$1")


def head_tail(c: Column, head: int = 40, tail: int = 40, most: int = 120) -> Column:
    """The first and last lines of a text of more than ``most``, with the number left out between them."""
    lines = F.split(c, "\n")
    n = F.size(lines)
    cut = F.concat_ws("\n", F.slice(lines, 1, head), F.array(F.concat(F.lit("... "), (n - head - tail).cast("string"), F.lit(" lines ..."))), F.slice(lines, -tail, tail))
    return F.when(n > most, cut).otherwise(c)


def words(c: Column, most: int) -> Column:
    """The first ``most`` words."""
    return F.concat_ws(" ", F.slice(F.split(F.trim(c), r"[ \t\r\n]+"), 1, most))


def tokens(c: Column) -> Column:
    """Estimated tokens: bytes / 4, at least 1, 0 if empty."""
    size = F.octet_length(c)
    return F.when(size > 0, F.greatest(F.lit(1), F.floor(size / 4))).otherwise(0).cast("long")


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 24)


def word_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets given as arrays; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def diff_text(name: Column, old: Column, new: Column, most: int = 100) -> Column:
    """Both sides of a change as text: a header, then lines that were there and lines that are, at most ``most`` each."""
    side = lambda c, sign: F.transform(F.slice(F.split(c, "\n"), 1, most), lambda x: F.concat(F.lit(sign), x))
    return F.concat_ws("\n", F.array(F.concat(F.lit("--- a/"), name), F.concat(F.lit("+++ b/"), name)), side(old, "-"), side(new, "+"))


def without_tags(c: Column) -> Column:
    """Without what stands between angle brackets."""
    return F.regexp_replace(c, "<[^>]*>?", "")


def cut(c: Column, most: int = 400) -> Column:
    """At most ``most`` characters, cut at the last white space if that leaves four fifths of them."""
    head = F.substring(c, 1, most)
    at = F.regexp_extract(head, r"(?s)^(.*)[ \t\n]", 1)
    return F.when(F.length(c) <= most, c).when(F.length(at) >= most * 4 // 5, at).otherwise(head)


def segments(path: Column, n: int = 2) -> Column:
    """The first ``n`` parts of a path."""
    return F.substring_index(path, "/", n)


def ago(seconds: Column) -> Column:
    """A span of time in few letters."""
    s = F.greatest(F.lit(0), seconds)
    told = lambda by, unit: F.concat(F.floor(s / by).cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, "just now").when(s < 3600, told(60, "m")).when(s < 86400, told(3600, "h")).otherwise(told(86400, "d"))


def clamped(x: Column) -> Column:
    """Between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def percent(part: Column, whole: Column) -> Column:
    """0 of nothing."""
    return F.when(whole > 0, 100 * part / whole).otherwise(F.lit(0.0))


def composed(c: Column) -> Column:
    """Unicode's composed form (NFC), for which Spark has no function; by Arrow batches."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return run(c)


def passages(c: Column, tag: str, f) -> Column:
    """``c`` with what stands between <tag> and </tag> put through ``f``, which gives the passage that takes its place, marks and all."""
    begin, end = f"<{tag}>", f"</{tag}>"
    inner = lambda p: F.substr(p, F.lit(len(begin) + 1), F.length(p) - len(begin) - len(end))
    # Up to the last end mark every passage that begins also ends, so none is looked for in vain.
    back = F.instr(F.reverse(c), end[::-1])
    whole = F.struct(c.alias("c"), F.when(back > 0, F.length(c) - back + 1).otherwise(0).alias("k"))

    def rewritten(s: Column) -> Column:
        parts = F.regexp_extract_all(F.substr(s["c"], F.lit(1), s["k"]), F.lit(f"(?s){begin}.*?{end}|[^<]+|<"), F.lit(0))
        done = F.array_join(F.transform(parts, lambda p: F.when(p.startswith(begin) & p.endswith(end), f(inner(p))).otherwise(p)), "")
        return F.concat(done, F.substr(s["c"], s["k"] + 1, F.length(s["c"])))

    return bound(whole, rewritten)


def thinned(c: Column, tag: str, mode: str = "words", stop: tuple[str, ...] = (), instead: dict[str, str] | None = None) -> Column:
    """Marked passages made shorter: ``all`` drops them, ``first`` leaves the first sentence, ``words`` leaves out stop words and puts shorter words in others' place.

    With ``first`` a passage of one sentence goes the way of ``words``. Nothing outside is touched.
    """
    begin, end = f"<{tag}>", f"</{tag}>"
    if mode not in ("all", "first", "words"):
        raise ValueError(f"unknown mode {mode!r}")

    def words(p: Column) -> Column:
        if stop:
            p = F.regexp_replace(p, r"(?i)\b(?:" + "|".join(map(re.escape, stop)) + r")\b[ \t]*", "")
        for long_, short in (instead or {}).items():
            p = F.regexp_replace(p, r"(?i)\b" + re.escape(long_) + r"\b", short)
        return F.concat(F.lit(begin), p, F.lit(end))

    def first(p: Column) -> Column:
        head = F.regexp_extract(p, r"(?s)^(.*?[.!?])(?:[ \t\r\n]|\z)", 1)
        return F.when((head != "") & (head != p), F.concat(F.lit(begin), head, F.lit(" ...[reasoning elided]"), F.lit(end))).otherwise(words(p))

    return passages(c, tag, {"all": lambda p: F.lit(""), "first": first, "words": words}[mode])


def common_area(path: Column | str) -> Column:
    """An aggregate: the longest directory that all paths of a group share, with a slash; of one path the path, without any "these files".

    The least and the greatest of the directories, segment by segment, share what all share, so a group
    is never put together.
    """
    path = F.col(path) if isinstance(path, str) else path
    folder = F.split(F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(""), "/")
    ends = F.struct(F.min(folder).alias("lo"), F.max(folder).alias("hi"))

    def shared(e: Column) -> Column:
        places = F.sequence(F.lit(1), F.least(F.size(e["lo"]), F.size(e["hi"])))
        k = F.size(F.filter(places, lambda i: F.slice(e["lo"], 1, i) == F.slice(e["hi"], 1, i)))
        return F.slice(e["lo"], 1, k)

    name = lambda s: F.when((F.size(s) == 0) | ((F.size(s) == 1) & (s[0] == "")), F.lit("these files")).otherwise(F.concat(F.array_join(s, "/"), F.lit("/")))
    return F.when(F.count(path) == 0, F.lit("these files")).when(F.count(path) == 1, F.min(path)).otherwise(bound(bound(ends, shared), name))
