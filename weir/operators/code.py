"""Symbols, references and the files that they are in; change logs and spans.

Range joins always have an equality on the blob, the largest on bins of its lines too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Lines of a file that are compared together.
BIN = 16


def _spans(symbols: DataFrame) -> DataFrame:
    """Each span of lines of a file once (blob_id, lo, hi), with the least symbol that has it, and the bins of lines that it touches."""
    g = symbols.groupBy("blob_id", F.col("line").alias("lo"), F.col("end_line").alias("hi")).agg(F.min("id").alias("sid"))
    return g.select("*", F.explode(F.sequence(F.floor(F.col("lo") / BIN), F.greatest(F.floor(F.col("lo") / BIN), F.floor(F.col("hi") / BIN)))).alias("bin"))


def _smallest(rows: DataFrame, spans: DataFrame, fits: Column, of: list[str]) -> DataFrame:
    """For each row (blob_id, bin, and what ``of`` names) the span that fits with the fewest lines, then the first: sid, null where none fits.

    The best is found as one number, so that it is aggregated before the shuffle and without sorting.
    """
    best = rows.join(spans, ["blob_id", "bin"]).filter(fits).groupBy("blob_id", *of).agg(F.min(F.shiftleft((F.col("hi") - F.col("lo")).cast("long"), 32) + F.col("lo")).alias("best"))
    lo = F.col("best").bitwiseAND(F.lit((1 << 32) - 1))
    found = best.select("blob_id", *of, lo.cast("int").alias("lo"), (lo + F.shiftright("best", 32)).cast("int").alias("hi"))
    return found.join(spans.select("blob_id", "lo", "hi", "sid").distinct(), ["blob_id", "lo", "hi"]).select("blob_id", *of, "sid")


def innermost(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """The smallest symbol that holds each reference; null where none does.

    A file's lines are cut into bins, so a reference meets only the symbols near it, however long the
    file; all references of one line are one.
    """
    lines = refs.select("blob_id", "line").distinct().withColumn("bin", F.floor(F.col("line") / BIN))
    found = _smallest(lines, _spans(symbols), (F.col("line") >= F.col("lo")) & (F.col("line") < F.col("hi")), ["line"])
    return refs.select("id", "blob_id", "line").distinct().join(found, ["blob_id", "line"], "left").select("id", "blob_id", "line", F.col("sid").alias("symbol_id"))


def parents(symbols: DataFrame) -> DataFrame:
    """The smallest longer symbol of the same file around each symbol."""
    spans = _spans(symbols)
    own = spans.select("blob_id", F.col("lo").alias("line"), F.col("hi").alias("end_line")).distinct().withColumn("bin", F.floor(F.col("line") / BIN))
    around = (F.col("lo") <= F.col("line")) & (F.col("hi") >= F.col("end_line")) & (F.col("hi") - F.col("lo") > F.col("end_line") - F.col("line"))
    found = _smallest(own, spans, around, ["line", "end_line"])
    return symbols.select("id", "blob_id", "line", "end_line").distinct().join(found, ["blob_id", "line", "end_line"], "left").withColumnRenamed("sid", "parent_id").select("id", "blob_id", "line", "end_line", "parent_id")


def resolve(refs: DataFrame, symbols: DataFrame, most: int = 8) -> DataFrame:
    """References joined with the symbols of that name in the same file; one candidate is inferred, several are ambiguous."""
    s = symbols.select("blob_id", F.col("name").alias("ref_name"), F.col("id").alias("symbol_id"), F.col("line").alias("at"))
    by = W.partitionBy("id", "blob_id", "ref_name")
    rows = refs.join(s, ["blob_id", "ref_name"]).withColumns({"n": F.count("*").over(by), "rank": F.row_number().over(by.orderBy("at", "symbol_id"))})
    return rows.filter(F.col("rank") <= most).select("id", "symbol_id", "rank", F.when(F.col("n") == 1, "inferred").otherwise("ambiguous").alias("confidence"))


def _bins(symbols: DataFrame) -> DataFrame:
    """Symbols once for each bin of lines that they touch; those without lines are left out."""
    at = lambda c: F.floor(c / BIN)
    return symbols.filter(F.col("end_line") > F.col("line")).withColumn("bin", F.explode(F.sequence(at(F.col("line")), at(F.col("end_line") - 1))))


def callers(refs: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Functions and methods with a reference to ``name``."""
    r = refs.filter(F.col("ref_name") == name).select(F.col("blob_id").alias("rb"), F.col("line").alias("at"), F.floor(F.col("line") / BIN).alias("of")).distinct()
    s = _bins(symbols.filter(F.col("kind").isin("function", "method")).select("name", "kind", "blob_id", "line", "end_line").distinct())
    inside = (F.col("blob_id") == F.col("rb")) & (F.col("bin") == F.col("of")) & (F.col("at") >= F.col("line")) & (F.col("at") < F.col("end_line"))
    return s.join(r, inside, "left_semi").select("name", "kind", "blob_id", "line").distinct()


def callees(refs: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Names that functions and methods called ``name`` refer to."""
    s = _bins(symbols.filter((F.col("name") == name) & F.col("kind").isin("function", "method")).select("blob_id", "line", "end_line").distinct())
    s = s.select(F.col("blob_id").alias("sb"), F.col("line").alias("lo"), F.col("end_line").alias("hi"), "bin")
    r = refs.select("ref_name", "blob_id", "line").distinct().withColumn("of", F.floor(F.col("line") / BIN))
    inside = (F.col("blob_id") == F.col("sb")) & (F.col("of") == F.col("bin")) & (F.col("line") >= F.col("lo")) & (F.col("line") < F.col("hi"))
    return r.join(s, inside, "left_semi").select("ref_name", "blob_id").distinct()


def orphans(blobs: DataFrame, file_revs: DataFrame) -> DataFrame:
    """Blobs that no file has."""
    return blobs.join(file_revs.select(F.col("blob_id").alias("id")), "id", "left_anti").select("id", "language")


def collisions(prs: DataFrame, comments: DataFrame, pr_commits: DataFrame, commits: DataFrame, diffs: DataFrame) -> DataFrame:
    """Paths that a pull request touches: by a comment, by one of its commits, or by its merge."""
    a = comments.filter("path is not null").select(F.col("pr_id").alias("number"), "path")
    b = pr_commits.join(commits.select(F.col("hash").alias("sha"), F.col("id").alias("commit_id")), "sha").join(diffs, "commit_id").select(F.col("pr_id").alias("number"), "path")
    c = prs.filter("state = 'merged'").select("number", F.col("id").alias("commit_id")).join(diffs, "commit_id").select("number", "path")
    return a.unionByName(b).unionByName(c).distinct()


def same_path(path: Column, wanted: list[str]) -> Column:
    """True where ``path`` is one of ``wanted``, lies below it, or ends in it at a slash."""
    return reduce(lambda x, y: x | y, [(path == w) | path.startswith(w.rstrip("/") + "/") | path.endswith("/" + w.lstrip("/")) for w in wanted], F.lit(False))


def repo_sizes(refs: DataFrame, commits: DataFrame, file_revs: DataFrame) -> DataFrame:
    """Commits and blobs of each repository; one without any stays with 0."""
    repos = refs.select("repo_id").distinct()
    c = commits.groupBy("repo_id").agg(F.count_distinct("id").alias("commits"))
    b = commits.select("repo_id", F.col("id").alias("commit_id")).join(file_revs, "commit_id").groupBy("repo_id").agg(F.count_distinct("blob_id").alias("blobs"))
    return repos.join(c, "repo_id", "left").join(b, "repo_id", "left").select("repo_id", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("commits", "blobs")))


def settle(changes: DataFrame, quiet: int) -> DataFrame:
    """Changes (path, sec, id, change) folded to one for each path and burst; a file created and deleted within it is left out."""
    by = W.partitionBy("path").orderBy("sec", "id")
    start = (F.coalesce(F.col("sec") - F.lag("sec").over(by), F.lit(quiet)) >= quiet).cast("int")
    rows = changes.withColumn("start", start).withColumn("burst", F.sum("start").over(by.rowsBetween(W.unboundedPreceding, 0)))
    g = rows.groupBy("path", "burst").agg(F.array_sort(F.collect_list(F.struct("sec", "id", "change"))).alias("all"), F.max("sec").alias("last"))

    def fold(a: Column, x: Column) -> Column:
        was = lambda p, q: (a == p) & (x == q)
        return F.when(was("created", "deleted"), "").when(was("created", "modified"), "created").when(was("deleted", "created") | was("renamed", "created"), "modified").otherwise(x)

    change = F.aggregate(F.transform("all", lambda r: r["change"]), F.lit(""), fold)
    return g.select("path", "burst", "last", change.alias("change")).filter("change <> ''")


def span_tree(spans: DataFrame) -> DataFrame:
    """Spans (trace, span, parent, name) with their parent's name; a parent that isn't in the trace gives <detached>."""
    p = spans.select("trace", F.col("span").alias("parent"), F.col("name").alias("parent_name"))
    rows = spans.join(p, ["trace", "parent"], "left")
    return rows.select("trace", "span", F.when(F.col("parent").isNull(), "<root>").otherwise(F.coalesce("parent_name", F.lit("<detached>"))).alias("under"))


def replay(log: DataFrame) -> DataFrame:
    """The state of each item after its log (item, sec, id, status, author): last status and author, first and last time."""
    at = F.struct("sec", "id")
    return log.groupBy("item").agg(F.max_by("status", at).alias("status"), F.max_by("author", at).alias("author"), F.min("sec").alias("created"), F.max("sec").alias("updated"), F.count("*").alias("n"))


def pauses(events: DataFrame, pause: str, resume: str) -> DataFrame:
    """Ranges from a pause to the next resume; a pause within one is ignored, one that isn't ended has no end."""
    by = W.partitionBy("author").orderBy("sec", "id")
    rows = events.filter(F.col("topic").isin(pause, resume)).withColumn("before", F.lag("topic").over(by)).filter(F.col("topic") != F.coalesce("before", F.lit(resume)))
    return rows.withColumn("end", F.lead("sec").over(by)).filter(F.col("topic") == pause).select("author", "id", F.col("sec").alias("start"), "end")


def work_blocks(events: DataFrame, short: float) -> DataFrame:
    """Islands of work of each author (author, sec, id, kind, size); a short text between two entries of work belongs to the island."""
    by = W.partitionBy("author").orderBy("sec", "id")
    bridge = (F.col("kind") == "assistant") & (F.col("size") < short) & (F.lag("kind").over(by) == "work") & (F.lead("kind").over(by) == "work")
    rows = events.withColumn("work", (F.col("kind") == "work") | F.coalesce(bridge, F.lit(False)))
    rows = rows.withColumn("start", (F.col("work") & ~F.coalesce(F.lag("work").over(by), F.lit(False))).cast("int")).withColumn("block", F.sum("start").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return rows.filter("work").groupBy("author", "block").agg(F.min("sec").alias("first"), F.max("sec").alias("last"), F.count("*").alias("n"))


def paired(events: DataFrame, call: str, result: str) -> DataFrame:
    """Calls with the result that comes next, null where something else does."""
    by = W.partitionBy("author").orderBy("sec", "id")
    return events.withColumn("result", F.when(F.lead("topic").over(by) == result, F.lead("id").over(by))).filter(F.col("topic") == call).select("author", "id", "result")


def by_author_set(conflicts: DataFrame) -> DataFrame:
    """Conflicts (file, authors, n_authors) by their authors; risk is high from three people or files on."""
    g = conflicts.groupBy("authors").agg(F.count("*").alias("n_files"), F.max("n_authors").alias("people"), F.array_join(F.array_sort(F.collect_list("file")), ",").alias("files"))
    return g.withColumn("risk", F.when((F.col("people") >= 3) | (F.col("n_files") >= 3), "high").otherwise("medium"))


def citations(links: DataFrame) -> DataFrame:
    """Links of a document once for each host, with the earliest time and its label, numbered by time and label."""
    g = links.groupBy("document", "host").agg(F.min("seen").alias("seen"), F.min_by("label", F.struct("seen", "label")).alias("label"))
    return g.withColumn("number", F.row_number().over(W.partitionBy("document").orderBy("seen", "label", "host")))
