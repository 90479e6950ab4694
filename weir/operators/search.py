"""Searches of commits, diffs, symbols, comments, files, pull requests and issues.

Each takes its filters as keyword arguments: words are alternatives, of which one must occur; other
filters are joined by "and". A filter that a search doesn't have is a TypeError. Filters become columns, so
that they reach the scan, and always come before the limit. A negated filter drops null values too.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.operators.work import reach

#: How sure an edge is, surest first; the branches that a search takes where none is named.
LEVELS = ("extracted", "inferred", "ambiguous")
MAIN = ("refs/heads/main", "refs/heads/master")
LIMIT = 20


def matches(column: Column, pattern: str, case: bool = False) -> Column:
    """Substring, or with ``*`` or ``?`` in it a pattern for the whole value; any case unless ``case``."""
    if "*" in pattern or "?" in pattern:
        glob = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in (pattern if case else pattern.lower()))
        return (column if case else F.lower(column)).rlike(f"(?s)^{glob}$")
    return column.contains(pattern) if case else F.contains(F.lower(column), F.lit(pattern.lower()))


def has_word(columns: Iterable[Column], words: Iterable[str], regex: str | None = None, case: bool = False) -> Column:
    """One of the words, or the Java regular expression, in one of the columns; true without any to look for."""
    words = list(words)
    if regex is not None:
        if words or not regex:
            raise ValueError("a regular expression can't be empty or joined with words")
        return reduce(lambda a, b: a | b, [c.rlike(regex) for c in columns])
    return reduce(lambda a, b: a | b, [matches(c, w, case) for w in words for c in columns]) if words else F.lit(True)


def like(column: str, wanted: str | None, unwanted: str | None = None, case: bool = False) -> Column:
    out = F.lit(True) if wanted is None else matches(F.col(column), wanted, case)
    return out if unwanted is None else out & ~matches(F.col(column), unwanted, case)


def equal(column: str, wanted: str | None, unwanted: str | None = None) -> Column:
    out = F.lit(True) if wanted is None else F.col(column) == wanted
    return out if unwanted is None else out & (F.col(column) != unwanted)


def in_time(column: str, after: str | None, before: str | None) -> Column:
    """Strictly after and before; a value that is no time matches nothing."""
    at = lambda v: F.unix_timestamp(F.try_to_timestamp(F.lit(v)))
    out = F.lit(True) if after is None else F.coalesce(F.col(column) > at(after), F.lit(False))
    return out if before is None else out & F.coalesce(F.col(column) < at(before), F.lit(False))


def at_least(column: str, level: str | None) -> Column:
    """Edges that are as sure as ``level`` or surer."""
    if level is None:
        return F.lit(True)
    if level not in LEVELS:
        raise ValueError(f"confidence is one of {', '.join(LEVELS)}")
    return F.col(column).isin(*LEVELS[: LEVELS.index(level) + 1])


def checked(limit: int) -> int:
    if limit < 1:
        raise ValueError("the limit is a number above 0")
    return limit


def in_repos(rows: DataFrame, repos: DataFrame | None, repo: str | None, not_repo: str | None) -> DataFrame:
    """``rows`` (repo_id) of the repositories with such a name; there are few repositories."""
    if repo is None and not_repo is None:
        return rows
    return rows.join(F.broadcast(repos.filter(like("name", repo, not_repo)).select(F.col("id").alias("repo_id"))), "repo_id", "left_semi")


def tips(file_revs: DataFrame, refs: DataFrame, rev: str | None = None, file: str | None = None, not_file: str | None = None, repos: DataFrame | None = None, repo: str | None = None, not_repo: str | None = None) -> DataFrame:
    """path, blob_id of files at the tip of a branch: ``rev`` is its name or a full ref, main and master where it is left out."""
    names = MAIN if rev is None else (rev if rev.startswith("refs/") else f"refs/heads/{rev}",)
    own = in_repos(refs.filter(F.col("name").isin(*names)), repos, repo, not_repo).select("commit_id")
    return file_revs.filter(like("path", file, not_file)).join(own, "commit_id", "left_semi").select("path", "blob_id").distinct()


def search_commits(commits: DataFrame, words=(), *, regex=None, case=False, author=None, not_author=None, message=None, not_message=None, after=None, before=None, repos=None, repo=None, not_repo=None, limit=LIMIT) -> DataFrame:
    if not words and not any((regex, author, not_author, message, not_message, after, before, repo, not_repo)):
        raise ValueError("a commit search needs a word or a filter")
    found = commits.filter(has_word([F.col("message")], words, regex, case) & like("author", author, not_author, case) & like("message", message, not_message, case) & in_time("timestamp", after, before))
    found = in_repos(found, repos, repo, not_repo)
    return found.select(F.substring("hash", 1, 10).alias("hash"), "author", F.substring("message", 1, 80).alias("message"), "timestamp", "id").orderBy(F.desc("timestamp"), "id").limit(checked(limit))


def search_diffs(diffs: DataFrame, commits: DataFrame, words=(), *, regex=None, case=False, file=None, not_file=None, author=None, not_author=None, message=None, after=None, before=None, repos=None, repo=None, not_repo=None, limit=LIMIT) -> DataFrame:
    """Changed paths that match the words, with the filters of commits and of files."""
    if not words and not regex:
        raise ValueError("a diff search needs a word")
    own = diffs.filter(has_word([F.col("path")], words, regex, case) & like("path", file, not_file, case))
    kept = in_repos(commits.filter(like("author", author, not_author, case) & like("message", message, None, case) & in_time("timestamp", after, before)), repos, repo, not_repo)
    found = own.join(kept.select(F.col("id").alias("commit_id"), "hash", "author", "timestamp"), "commit_id")
    return found.select("path", F.substring("hash", 1, 10).alias("hash"), "author", "timestamp", "commit_id").orderBy(F.desc("timestamp"), "commit_id", "path").limit(checked(limit))


def search_symbols(symbols: DataFrame, blobs: DataFrame, file_revs: DataFrame, refs: DataFrame, words=(), *, regex=None, case=False, kind=None, lang=None, not_lang=None, returns=None, limit=LIMIT, **files) -> DataFrame:
    """Symbols of files at the tips of branches; ``returns`` keeps functions and methods only. ``files``: as ``tips`` takes them."""
    if not words and not any((regex, kind, lang, not_lang, returns, files.get("file"), files.get("not_file"))):
        raise ValueError("a symbol search needs a word, or kind, lang, file or returns")
    own = symbols.filter(has_word([F.col("name")], words, regex, case) & equal("kind", kind))
    if returns is not None:
        own = own.filter(matches(F.col("return_type"), returns, case) & F.col("kind").isin("function", "method"))
    kept = blobs.filter(equal("language", lang, not_lang)).select(F.col("id").alias("blob_id"), "language")
    found = own.join(kept, "blob_id").join(tips(file_revs, refs, **files), "blob_id").select("path", "line", "name", "kind", "language").distinct()
    return found.orderBy("path", "line", "name", "kind").limit(checked(limit))


def _linked(edges: DataFrame, symbols: DataFrame, file_revs: DataFrame, refs: DataFrame, seed: DataFrame, backwards: bool, depth: int, confidence: str | None, limit: int, files: dict) -> DataFrame:
    if not 1 <= depth <= 10:
        raise ValueError("depth is 1 to 10")
    sure = edges.filter((F.col("kind") == "call") & at_least("confidence", confidence))
    end, other = ("src_symbol_id", "dst_symbol_id") if backwards else ("dst_symbol_id", "src_symbol_id")
    first = seed.select(F.col(end).alias("node")).distinct()
    nodes = reach(sure.select(F.col("src_symbol_id").alias("src"), F.col("dst_symbol_id").alias("dst")), first, depth - 1, backwards)
    nodes = first.withColumn("depth", F.lit(1)).unionByName(nodes.withColumn("depth", F.col("depth") + 1))
    found = nodes.join(symbols.select(F.col("id").alias("node"), "name", "kind", "blob_id"), "node").join(tips(file_revs, refs, **files), "blob_id")
    return found.select("path", "name", "kind", "depth").distinct().orderBy("depth", "path", "name", "kind").limit(checked(limit))


def callers(edges: DataFrame, symbols: DataFrame, file_revs: DataFrame, refs: DataFrame, name: str, *, case=False, confidence=None, depth=1, limit=LIMIT, **files) -> DataFrame:
    """Functions that call a symbol whose name matches, over resolved edges, and with ``depth`` those that call them, and so on."""
    functions = symbols.filter("kind = 'function'").select(F.col("id").alias("src_symbol_id"))
    seed = edges.filter((F.col("kind") == "call") & matches(F.col("dst_name"), name, case) & at_least("confidence", confidence)).join(functions, "src_symbol_id", "left_semi")
    return _linked(edges, symbols, file_revs, refs, seed, True, depth, confidence, limit, files)


def callees(edges: DataFrame, symbols: DataFrame, file_revs: DataFrame, refs: DataFrame, name: str, *, case=False, confidence=None, depth=1, limit=LIMIT, **files) -> DataFrame:
    """What functions whose name matches call, over resolved edges, and with ``depth`` what that calls, and so on."""
    functions = symbols.filter((F.col("kind") == "function") & matches(F.col("name"), name, case)).select(F.col("id").alias("src_symbol_id"))
    seed = edges.filter((F.col("kind") == "call") & at_least("confidence", confidence)).join(functions, "src_symbol_id", "left_semi")
    return _linked(edges, symbols, file_revs, refs, seed, False, depth, confidence, limit, files)


def search_pull_requests(prs: DataFrame, comments: DataFrame, words=(), *, case=False, author=None, state=None, after=None, before=None, limit=LIMIT) -> DataFrame:
    """Pull requests whose title or any comment has one of the words; author and state are whole values."""
    own = prs.filter(equal("author", author) & equal("state", state) & in_time("updated_at", after, before))
    if words:
        said = comments.filter(has_word([F.col("body")], words, None, case)).select(F.col("pr_id").alias("id"), F.lit(True).alias("said")).distinct()
        own = own.join(said, "id", "left").filter(F.col("said") | has_word([F.col("title")], words, None, case))
    return own.select("number", "title", "author", "state", "updated_at").orderBy(F.desc("updated_at"), "number").limit(checked(limit))


def search_issues(issues: DataFrame, comments: DataFrame, words=(), *, case=False, author=None, state=None, after=None, before=None, limit=LIMIT) -> DataFrame:
    """Issues whose title, text or any comment has one of the words; author and state are whole values."""
    own = issues.filter(equal("author", author) & equal("state", state) & in_time("updated_at", after, before))
    if words:
        said = comments.filter(has_word([F.col("body")], words, None, case)).select(F.col("issue_id").alias("number"), F.lit(True).alias("said")).distinct()
        own = own.join(said, "number", "left").filter(F.col("said") | has_word([F.col("title"), F.col("body")], words, None, case))
    return own.select("number", "title", "author", "state", "updated_at").orderBy(F.desc("updated_at"), "number").limit(checked(limit))


def search_comments(comments: DataFrame, blobs: DataFrame, file_revs: DataFrame, refs: DataFrame, words=(), *, regex=None, case=False, kind=None, lang=None, not_lang=None, limit=LIMIT, **files) -> DataFrame:
    """Comments in files at the tips of branches, a row for each path that has the file."""
    if not words and not any((regex, kind, lang, not_lang, files.get("file"), files.get("not_file"))):
        raise ValueError("a comment search needs a word, or kind, lang or file")
    own = comments.filter(has_word([F.col("text")], words, regex, case) & equal("kind", kind))
    kept = blobs.filter(equal("language", lang, not_lang)).select(F.col("id").alias("blob_id"), "language")
    found = own.join(kept, "blob_id").join(tips(file_revs, refs, **files), "blob_id")
    return found.select("path", F.col("text").alias("snippet"), "kind", "line", "language").orderBy("path", "line", "kind", "snippet").limit(checked(limit))


def search_code(files: DataFrame, words=(), *, regex=None, case=False, file=None, not_file=None, lang=None, not_lang=None, limit=LIMIT) -> DataFrame:
    """Files (path, language, content) with one of the words, and the first line that has it."""
    if not words and not regex:
        raise ValueError("a code search needs a word")
    own = files.filter(like("path", file, not_file, case) & equal("language", lang, not_lang) & has_word([F.col("content")], words, regex, case))
    lines = F.split("content", "\n")
    line = F.array_position(F.transform(lines, lambda x: has_word([x], words, regex, case)), True).cast("int")
    found = own.select("path", "language", line.alias("line"), F.element_at(lines, F.greatest(line, F.lit(1))).alias("text")).orderBy("path").limit(checked(limit))
    return found.select("path", "language", "line", F.when(F.col("line") > 0, F.substring(F.trim("text"), 1, 120)).alias("snippet"))


def search_terms(queries: DataFrame) -> DataFrame:
    """id, terms: what to mark in a snippet, of queries (id, text): without operators, signs and field names, two bytes at least."""
    raw = F.transform(F.split(F.trim("text"), r"\s+"), lambda t: F.regexp_replace(t, r'^[+\-"*?()]+|[+\-"*?()]+$', ""))
    kept = F.filter(raw, lambda t: ~F.upper(t).isin("", "AND", "OR", "NOT"))
    bare = F.transform(kept, lambda t: F.when(F.instr(t, ":") > 0, F.substr(t, F.instr(t, ":") + 1)).otherwise(t))
    return queries.select("id", F.filter(bare, lambda t: F.octet_length(t) >= 2).alias("terms"))
