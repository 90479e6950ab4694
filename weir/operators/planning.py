"""What a plan is enriched with: prior art, context, signals, citations; and how work is told in few words."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weir.functions import text as T
from weir.operators.sessions import occurrences

DAY = 86400
#: How many days back each corpus counts.
MOST_DAYS = {"session": 90, "murmur": 7, "plan": 90}


def tokens(c: Column, least: int = 4) -> Column:
    """Distinct lower-case words of at least ``least`` letters or digits."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= least))


def on_topic(headings: DataFrame, topics: DataFrame) -> DataFrame:
    """Headings (id, heading) that share a word of four letters or more with some topic (topic): one join on words."""
    words = topics.select(F.explode(tokens(F.col("topic"))).alias("word")).distinct()
    return headings.select("id", F.explode(tokens(F.col("heading"))).alias("word")).join(words, "word", "left_semi").select("id").distinct()


def evidence(items: DataFrame, sessions: DataFrame, murmurs: DataFrame) -> DataFrame:
    """Items (id) with the session whose name ends in their key Ox<id> and the number of murmurs of the derived key Mx<id>."""
    key = F.concat(F.lit("Ox"), F.col("id").cast("string"))
    s = sessions.select(F.substring_index("name", "-", -1).alias("key"), "name").groupBy("key").agg(F.max("name").alias("session"))
    m = murmurs.select(F.concat(F.lit("Ox"), F.regexp_extract("key", "^Mx(.+)$", 1)).alias("key")).groupBy("key").agg(F.count("*").alias("murmurs"))
    rows = items.select("id", key.alias("key")).join(s, "key", "left").join(m, "key", "left")
    return rows.select("id", "session", F.coalesce("murmurs", F.lit(0)).alias("murmurs"))


def compared(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each reference (name, text) with how alike the candidate of that name is; without one everything is 0."""
    rows = references.join(candidates.select("name", F.col("text").alias("found")), "name", "left")
    return rows.select("name", F.col("found").isNotNull().alias("there"), F.round(F.coalesce(T.jaccard(T.word_set(F.col("text")), T.word_set(F.col("found"))), F.lit(0.0)), 6).alias("score"))


def prior_art(hits: DataFrame, least: float = 0.6, most: int = 3) -> DataFrame:
    """Of each plan's hits (plan, id, score, sec) those that score enough, best and then latest first, ``most`` of them."""
    place = F.row_number().over(W.partitionBy("plan").orderBy(F.desc("score"), F.desc("sec"), "id"))
    return hits.filter(F.col("score") >= least).withColumn("place", place).filter(F.col("place") <= most).select("plan", "id", "score", "place")


def bundle(items: DataFrame, most: int, least: float = 0.55) -> DataFrame:
    """Of each plan's items (plan, kind, ref, score) every (kind, ref) once with its best score, ranked and cut at ``most``."""
    best = items.filter(F.col("score") >= least).groupBy("plan", "kind", "ref").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("plan").orderBy(F.desc("score"), "kind", "ref"))
    return best.withColumn("place", place).filter(F.col("place") <= most)


def signals(annotations: DataFrame, files: int = 2, steps: int = 5) -> DataFrame:
    """Of each plan's annotations (plan, kind, file, step) the counts, whether they matter, and whether the plan is more than trivial."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    g = annotations.groupBy("plan").agg(n("collision").alias("collisions"), n("prior-art").alias("prior_art"), n("expert-route").alias("experts"), F.count_distinct("file").alias("files"), F.count_distinct("step").alias("steps"))
    return g.withColumns({"material": F.col("collisions") + F.col("experts") + F.col("prior_art") > 0, "more": (F.col("files") >= files) | (F.col("steps") >= steps)})


def searched(corpora: dict[str, DataFrame], terms: list[str], now: int, k: int) -> DataFrame:
    """Texts of all corpora (id, sec, content) that hold every term, each corpus back to its age; a text without a time counts."""
    recent = [df.filter(F.col("sec").isNull() | (F.col("sec") >= now - MOST_DAYS[name] * DAY)).select(F.lit(name).alias("corpus"), F.col("id").cast("string").alias("id"), "sec", F.lower("content").alias("low")) for name, df in corpora.items()]
    rows = reduce(DataFrame.unionByName, recent)
    for t in terms:
        rows = rows.filter(F.contains("low", F.lit(t)))
    total = sum((F.least(F.lit(10), occurrences(F.col("low"), t)) for t in terms), F.lit(0))
    score = F.round(0.5 + F.least(F.lit(0.5), total / 100), 6)
    return rows.select("corpus", "id", "sec", score.alias("score")).orderBy(F.desc("score"), F.desc_nulls_last("sec"), "corpus", "id").limit(k)


def effective(mode: bool, env: Column, kb: Column, own: Column, fallback: Column) -> Column:
    """The value of a setting from its layers, "" where unset: env, kb, own, fallback.

    For a recording mode "disabled" in kb or own vetoes the other, and own comes before kb.
    """
    named = lambda c: F.nullif(c, F.lit(""))
    if not mode:
        return F.coalesce(named(env), named(kb), named(own), fallback)
    veto = F.when((kb == "disabled") | (own == "disabled"), "disabled")
    return F.coalesce(named(env), veto, named(own), named(kb), fallback)


@dataclass(frozen=True)
class Pattern:
    """A sign of a terminal state: a value at a JSON path, or a Java regular expression behind cheap substrings, for entries of some roles."""

    id: str
    reason: str
    path: str | None = None
    equals: str | None = None
    regex: str | None = None
    substrings: list[str] = field(default_factory=list)
    roles: list[str] = field(default_factory=lambda: ["system"])


def load_patterns(text: str) -> list[Pattern]:
    """A catalogue as JSON, a list of objects; an unknown key or a pattern of neither kind is an error."""
    found = [Pattern(**entry) for entry in json.loads(text)]
    for p in found:
        if (p.path is None) == (p.regex is None):
            raise ValueError(f"{p.id} needs either a path or a regex")
    return found


def first_match(patterns: list[Pattern], role: Column, content: Column, raw: Column) -> Column:
    """Struct of pattern and reason of the first that fits, all by path before those by expression; null without one."""
    out = F.lit(None).cast("struct<pattern: string, reason: string>")
    by_path, by_regex = [p for p in patterns if p.path], [p for p in patterns if p.regex]
    for p in reversed(by_path + by_regex):
        if p.path:
            fits = F.get_json_object(raw, f"$.{p.path}") == p.equals
        else:
            near = reduce(lambda a, b: a | b, [F.contains(content, F.lit(s)) for s in p.substrings], F.lit(not p.substrings))
            fits = role.isin(*p.roles) & near & content.rlike(p.regex)
        out = F.when(F.coalesce(fits, F.lit(False)), F.struct(F.lit(p.id).alias("pattern"), F.lit(p.reason).alias("reason"))).otherwise(out)
    return out


def chapters(frames: DataFrame, chapter: str) -> DataFrame:
    """Frames of a chapter of each discussion in order of time."""
    place = F.row_number().over(W.partitionBy("discussion").orderBy("seconds", "id"))
    return frames.filter(F.col("chapter") == chapter).withColumn("place", place).select("discussion", "id", "seconds", "place")


def visual_types(frames: DataFrame, by: list[str]) -> DataFrame:
    """The types of the frames of each discussion or chapter, sorted; null where none has one."""
    types = F.array_sort(F.collect_set(F.nullif("content_type", F.lit(""))))
    return frames.groupBy(*by).agg(F.when(F.size(types) > 0, F.array_join(types, ",")).alias("types"))


def discussion_index(discussions: DataFrame, frames: DataFrame) -> DataFrame:
    """A line for each discussion (name, title, created): its date, the name's or else that of creation, and its types; newest name first."""
    date = F.coalesce(F.nullif(F.regexp_extract("name", r"^(\d{4}-\d\d-\d\d)", 1), F.lit("")), F.date_format(F.timestamp_seconds("created"), "yyyy-MM-dd"))
    rows = discussions.join(visual_types(frames, ["discussion"]).withColumnRenamed("discussion", "name"), "name", "left")
    tags = F.when(F.col("types").isNotNull(), F.concat(F.lit(" ["), "types", F.lit("]"))).otherwise("")
    return rows.select("name", date.alias("date"), F.concat(date, F.lit(" "), "title", tags, F.lit(" -- discussions/"), "name", F.lit("/")).alias("line")).orderBy(F.desc("name"))


def identity(rows: DataFrame, by: str, item: str) -> DataFrame:
    """What identifies a set whatever its order: version N<size>-<8 digits> and hash of its sorted items."""
    items = F.array_sort(F.collect_set(item))
    g = rows.groupBy(by).agg(F.sha2(F.concat(F.array_join(items, "\x00"), F.lit("\x00")), 256).alias("hash"), F.size(items).alias("n"))
    return g.select(by, F.concat(F.lit("N"), F.col("n").cast("string"), F.lit("-"), F.substring("hash", 1, 8)).alias("version"), "hash")


def status_lines(items: DataFrame) -> DataFrame:
    """What is to be told of each status (items: status, owner, type) in two, four and eight words."""
    kinds = items.groupBy("status", "type").agg(F.count("*").alias("n"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["type"], F.lit("s"))), ", ")
    g = items.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("owner").alias("people")).join(kinds.groupBy("status").agg(parts.alias("parts")), "status")
    n, who = F.concat_ws(" ", F.col("n").cast("string"), "status"), F.concat(F.col("people").cast("string"), F.lit(" coworkers"))
    return g.select("status", n.alias("two"), T.words(F.concat_ws(", ", n, who), 4).alias("four"), T.words(F.concat(n, F.lit(" by "), who, F.lit(": "), "parts"), 8).alias("eight"))


def headline(items: DataFrame, blocked: DataFrame) -> DataFrame:
    """One sentence on how far everything is: a row from partial sums."""
    g = items.agg(F.count("*").alias("n"), *(F.count_if(F.col("status") == s).alias(s) for s in ("closed", "in_progress", "open")), F.count_distinct("owner").alias("people"))
    b = blocked.agg(F.count_distinct("id").alias("blocked"))
    some = lambda c, word: F.when(F.col(c) > 0, F.concat(F.lit(", "), F.col(c).cast("string"), F.lit(word))).otherwise("")
    told = F.concat(F.col("closed").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" carts completed"), some("in_progress", " in progress"), some("open", " open"), some("people", " coworkers"), some("blocked", " blocked"), F.lit("."))
    rows = g.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one")  # a row on each side
    return rows.select(F.when(F.col("n") == 0, "No carts found in this time window.").otherwise(told).alias("headline"))


def rendered_sources(cites: DataFrame) -> DataFrame:
    """doc, text: the Sources section of each document's citations (doc, num, label, url, key); labels that have no url carry their key in a comment."""
    num = F.col("num").cast("string")
    label = F.regexp_replace("label", r"([\[\]])", r"\\$1")
    hidden = F.when((F.col("key") != "") & ~F.col("key").startswith("label:"), F.concat(F.lit(" <!-- ref:"), "key", F.lit(" -->"))).otherwise("")
    entry = F.when(F.col("url") != "", F.concat(num, F.lit(". ["), label, F.lit("]["), num, F.lit("]"))).otherwise(F.concat(num, F.lit(". "), "label", hidden))
    ref = F.when(F.col("url") != "", F.concat(F.lit("["), num, F.lit("]: "), "url"))
    rows = F.array_sort(F.collect_list(F.struct("num", entry.alias("entry"), ref.alias("ref"))))
    refs = F.filter(F.transform(rows, lambda x: x["ref"]), lambda x: x.isNotNull())
    body = F.concat(F.lit("## Sources\n\n"), F.array_join(F.transform(rows, lambda x: x["entry"]), "\n"), F.lit("\n"), F.when(F.size(refs) > 0, F.concat(F.lit("\n"), F.array_join(refs, "\n"), F.lit("\n"))).otherwise(""))
    return cites.groupBy("doc").agg(body.alias("text"))


def parsed_sources(texts: DataFrame) -> DataFrame:
    """doc, num, label, url, key of the Sources section of texts (doc, text) outside fenced code; lines of no known form are skipped.

    The key is that of the hidden comment, else the url, else the label.
    """
    bare = F.regexp_replace("text", r"(?ms)^```.*?^```[^\n]*$", "")
    section = F.regexp_extract(bare, r"(?s)(?:^|\n)## Sources[ \t]*\n(.*?)(?:\n## |\z)", 1)
    lines = texts.select("doc", F.posexplode(F.transform(F.split(section, "\n"), lambda x: F.trim(x))).alias("at", "line"))
    own = lines.select(
        "doc", F.regexp_extract("line", r"<!-- ref:(.*?) -->$", 1).alias("ref"), F.trim(F.regexp_replace("line", r"<!-- ref:.*? -->$", "")).alias("line"),
    )
    link = r"^(\d+)\. \[((?:\\.|[^\]\\])*)\]\[(\d+)\]$"
    linked = F.col("line").rlike(link)
    num = F.regexp_extract("line", r"^(\d+)\. ", 1)
    entries = own.filter(num != "").select(
        "doc", num.cast("long").alias("num"), F.when(linked, F.regexp_extract("line", link, 3)).alias("to"), "ref",
        F.when(linked, F.regexp_replace(F.regexp_extract("line", link, 2), r"\\([\[\]])", "$1")).otherwise(F.trim(F.regexp_extract("line", r"^\d+\. (.*)$", 1))).alias("label"))
    urls = own.select("doc", F.regexp_extract("line", r"^\[(\d+)\]: (\S+)$", 1).alias("to"), F.regexp_extract("line", r"^\[(\d+)\]: (\S+)$", 2).alias("found")).filter(F.col("to") != "")
    rows = entries.join(urls, ["doc", "to"], "left").withColumn("url", F.coalesce("found", F.lit("")))
    key = F.when(F.col("ref") != "", F.col("ref")).when(F.col("url") != "", F.col("url")).otherwise(F.concat(F.lit("label:"), "label"))
    return rows.filter("label <> ''").select("doc", "num", "label", "url", key.alias("key"))


def merged_citations(cites: DataFrame) -> DataFrame:
    """Citations of several inputs (doc, input, num, label, url, key) with the number that each gets in the merged list of its document.

    The list is in order of first appearance, each key once. An entry that is only a label takes the
    url of the first entry after it that has that label and a url; other entries never merge by label.
    """
    at = F.struct("input", "num")
    key = F.when(F.col("key") == "", F.concat(F.lit("label:"), "label")).otherwise(F.col("key"))
    rows = cites.withColumn("key", key)
    first = rows.groupBy("doc", "key").agg(F.min(at).alias("at"), F.min_by("label", at).alias("label"), F.min_by("url", at).alias("url"))
    bare = first.filter(F.col("key").startswith("label:") & (F.col("url") == "")).select("doc", "label", F.col("key").alias("bare"), F.col("at").alias("since"))
    later = first.filter("url <> ''").join(bare, ["doc", "label"]).filter(F.col("at") > F.col("since"))
    taken = later.groupBy("doc", "bare").agg(F.min(F.struct("at", "key", "url")).alias("t")).select("doc", "bare", F.col("t.key").alias("key"), F.col("t.url").alias("url"))
    lists = first.join(taken.select("doc", "key"), ["doc", "key"], "left_anti").withColumn("number", F.row_number().over(W.partitionBy("doc").orderBy("at")))
    numbers = lists.select("doc", "key", "number", F.col("url").alias("own"))
    moved = taken.join(numbers.select("doc", F.col("key").alias("bare"), "number"), ["doc", "bare"])
    known = numbers.join(moved.select("doc", "number", F.col("url").alias("better")), ["doc", "number"], "left").select("doc", "key", "number", F.coalesce("better", "own").alias("link"))
    known = known.unionByName(moved.select("doc", "key", "number", F.col("url").alias("link")))
    return rows.select("doc", "input", "num", "key").join(known, ["doc", "key"]).select("doc", "input", "num", "number", "link")


def renumbered(text: Column, numbers: Column) -> Column:
    """``text`` with the markers [n] that the map ``numbers`` (string to string) knows replaced, outside code spans and fences."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)```.*?(?:```|\z)|`[^`\n]*`|[^`]+|`"), F.lit(0))

    def rewrite(part: Column) -> Column:
        pieces = F.regexp_extract_all(part, F.lit(r"(?s)\[\d+\]|[^\[]+|\["), F.lit(0))
        return F.array_join(F.transform(pieces, lambda x: F.coalesce(F.when(x.rlike(r"^\[\d+\]$"), F.concat(F.lit("["), F.get(F.map_values(F.map_filter(numbers, lambda k, _: k == F.regexp_extract(x, r"\d+", 0))), 0), F.lit("]"))), x)), "")

    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("`") & (F.length(p) > 1), p).otherwise(rewrite(p))), "")


def cues(texts: DataFrame) -> DataFrame:
    """doc, n, speaker, said: the cues of WebVTT texts (doc, text); a text without the header has none, a cue without text is skipped.

    Blank lines part the blocks of a text; what follows a block's time line is the cue.
    """
    own = texts.filter(F.trim(F.regexp_extract("text", r"^[^\n]*", 0)).startswith("WEBVTT"))
    blocks = F.split(F.regexp_replace("text", "\r", ""), r"\n[ \t]*\n[ \t\n]*")
    rows = own.select("doc", F.posexplode(blocks).alias("n", "block")).filter(F.contains("block", F.lit("-->")))
    lines = F.filter(F.transform(F.split(F.regexp_extract("block", r"(?s)^.*?-->[^\n]*\n(.*)$", 1), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    voice = r"^<v ([^>]*)>"
    clean = lambda x: F.when(x.rlike(voice), F.trim(F.regexp_replace(F.regexp_replace(x, voice, ""), "</v>$", ""))).otherwise(F.regexp_replace(x, r"<[^>]*>?", ""))
    speakers = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, voice, 1)), lambda s: s != "")
    found = rows.select("doc", "n", F.coalesce(F.get(speakers, 0), F.lit("")).alias("speaker"), F.array_join(F.transform(lines, clean), " ").alias("said"), F.size(lines).alias("k"))
    return found.filter("k > 0").drop("k")


def spoken(cues_: DataFrame) -> DataFrame:
    """doc, text: "speaker: what was said", the cues that follow each other from one speaker as one line."""
    by = W.partitionBy("doc").orderBy("n")
    rows = cues_.filter("said <> ''").withColumn("start", ((F.col("speaker") == "") | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(by))).cast("int"))
    rows = rows.withColumn("turn", F.sum("start").over(by.rowsBetween(W.unboundedPreceding, 0)))
    turns = rows.groupBy("doc", "turn", "speaker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "said"))), lambda x: x["said"]), " ").alias("said"))
    line = F.when(F.col("speaker") != "", F.concat("speaker", F.lit(": "), "said")).otherwise(F.col("said"))
    return turns.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def dated(names: DataFrame, since: str, until: str) -> DataFrame:
    """Memory files (name) whose day, ISO week or month overlaps [since, until): name, layer, start and end; names of no known form are left out."""
    part = lambda pattern, i=1: F.regexp_extract("name", pattern, i)
    week = r"(?:^|/)(\d{4})-W(\d\d)(?:[^/]*)\.md$"
    parts = F.struct(part(r"(?:^|/)(\d{4}-\d\d-\d\d)(?:[^/]*)\.md$").alias("day"), part(week).alias("year"), part(week, 2).alias("week"), part(r"(?:^|/)(\d{4}-\d\d)\.md$").alias("month"))
    # As a generator, so that each name is taken apart once and not again for every condition.
    rows = names.select("name", F.inline(F.filter(F.array(T.bound(parts, _span)), lambda s: s.isNotNull())))
    return rows.filter((F.col("start") < F.lit(until).cast("date")) & (F.col("end") > F.lit(since).cast("date")))


def _span(p: Column) -> Column:
    """layer, start and end of the day, ISO week or month that a name's parts tell; null for none."""
    day, month = F.try_to_date(p["day"], "yyyy-MM-dd"), F.try_to_date(F.concat(p["month"], F.lit("-01")), "yyyy-MM-dd")
    fourth = F.try_to_date(F.concat(p["year"], F.lit("-01-04")), "yyyy-MM-dd")  # always in week 1
    monday = F.date_add(F.trunc(fourth, "week"), (F.coalesce(p["week"].try_cast("int"), F.lit(1)) - 1) * 7)
    real = F.concat(F.extract(F.lit("YEAROFWEEK"), monday).cast("string"), F.lpad(F.weekofyear(monday).cast("string"), 2, "0")) == F.concat(p["year"], p["week"])
    span = F.when(day.isNotNull(), F.struct(F.lit("daily").alias("layer"), day.alias("start"), F.date_add(day, 1).alias("end")))
    span = span.when(fourth.isNotNull() & real, F.struct(F.lit("weekly").alias("layer"), monday.alias("start"), F.date_add(monday, 7).alias("end")))
    return span.when(month.isNotNull(), F.struct(F.lit("monthly").alias("layer"), month.alias("start"), F.add_months(month, 1).alias("end")))


def assembled(spans: DataFrame, late: int = 120) -> DataFrame:
    """Each trace's tree (spans: trace, span, sec, root) when its first root ends: the spans that came before it; what comes within ``late`` seconds after is dropped, what comes later waits for another root."""
    at = F.struct("sec", "span")
    root = spans.filter("root").groupBy("trace").agg(F.min(at).alias("r"))
    rows = spans.join(root, "trace")
    return rows.groupBy("trace").agg(
        F.min("r.span").alias("root"), F.count_if(F.struct("sec", "span") <= F.col("r")).alias("spans"),
        F.count_if((F.struct("sec", "span") > F.col("r")) & (F.col("sec") <= F.col("r.sec") + late)).alias("dropped"), F.count_if(F.col("sec") > F.col("r.sec") + late).alias("waiting"))


def outcomes(events: DataFrame, topic: str, quiet: int) -> DataFrame:
    """Of each author's marks (topic): how many there were, how many silence confirmed, how many another event revoked."""
    nxt = F.lead("sec").over(W.partitionBy("author").orderBy("sec", "id"))
    rows = events.withColumn("wait", nxt - F.col("sec")).filter(F.col("topic") == topic)
    calm = F.col("wait").isNull() | (F.col("wait") >= quiet)
    return rows.groupBy("author", "importance").agg(F.count("*").alias("hits"), F.count_if(calm).alias("confirmed"), F.count_if(~calm).alias("revoked"))
