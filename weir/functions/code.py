"""Languages of files by name, and the comments in their text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extension (any case) and language.
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "tsx": "tsx", "jsx": "jsx", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp",
    "go": "go", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "cs": "csharp", "sh": "shell", "bash": "shell", "sql": "sql", "html": "html", "htm": "html", "css": "css",
    "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "md": "markdown", "markdown": "markdown", "r": "r", "lua": "lua", "zig": "zig", "ex": "elixir", "exs": "elixir", "erl": "erlang", "hrl": "erlang",
    "hs": "haskell", "ml": "ocaml", "mli": "ocaml", "pl": "perl", "pm": "perl", "proto": "protobuf", "dart": "dart",
}
#: How languages mark comments to the end of a line, and the beginning and end of others; ("" where they have none).
MARKS = {
    "go c cpp java javascript typescript tsx jsx rust swift kotlin scala csharp dart php zig protobuf css": ("//", "/*", "*/"),
    "python ruby shell r perl elixir yaml toml": ("#", "", ""), "html xml markdown": ("", "<!--", "-->"), "sql": ("--", "/*", "*/"),
    "lua": ("--", "--[[", "]]"), "haskell": ("--", "{-", "-}"), "ocaml": ("", "(*", "*)"), "erlang": ("%", "", ""),
}
COMMENTED = {language: marks for names, marks in MARKS.items() for language in names.split()}
NESTED = {"haskell"}
#: Quotes that end only where they stand again, by language; in all languages " and ' are quotes in which \ shields a letter.
LONG_QUOTES = {"python": ['"""', "'''"], "elixir": ['"""'], **dict.fromkeys("go javascript typescript tsx jsx".split(), ["`"])}
_REST = {q: re.compile(rf"[^{q}\\]*+(?:\\.[^{q}\\]*+)*+{q}?", re.DOTALL) for q in "\"'"}


def language_of(path: Column) -> Column:
    """The language that a file's extension tells; null for an unknown one or none."""
    name = F.substring_index(path, "/", -1)
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.when(F.instr(name, ".") > 0, F.try_element_at(known, F.lower(F.substring_index(name, ".", -1))))


@cache
def _marks(language: str) -> re.Pattern:
    """What can begin a comment or a quote, the longest of those that begin alike first."""
    line, begin, _ = COMMENTED[language]
    found = [begin, line, *LONG_QUOTES.get(language, []), '"', "'"]
    return re.compile("|".join(re.escape(x) for x in found if x))


def _end_of_nested(source: str, at: int, begin: str, end: str) -> int:
    """Where the end mark stands that closes the comment whose text begins at ``at``; -1 if none does."""
    depth = 1
    for m in re.compile(f"{re.escape(begin)}|{re.escape(end)}").finditer(source, at):
        depth += 1 if m.group() == begin else -1
        if not depth:
            return m.start()
    return -1


def scanned(source: str, language: str) -> list[tuple[str, str, int, int, int, int]]:
    """(text, kind, line, end_line, col, end_col) of each comment, in order.

    The scan leaps from mark to mark and goes over each letter once, however long a comment or a quote is.
    """
    out, marks, at = [], _marks(language), 0
    to_end, begin, end = COMMENTED[language]
    line, row, seen = 1, 0, 0  # number and first letter of the line at ``seen``

    def place(p: int) -> tuple[int, int]:
        nonlocal line, row, seen
        line += source.count("\n", seen, p)
        row, seen = max(row, source.rfind("\n", seen, p) + 1), p
        return line, p - row + 1

    while m := marks.search(source, at):
        mark, p, block = m.group(), m.start(), m.group() == begin
        if block or mark == to_end:
            if not block:
                close = after = (source.find("\n", m.end()) + 1 or len(source) + 1) - 1
            else:
                close = _end_of_nested(source, m.end(), begin, end) if language in NESTED else source.find(end, m.end())
                if close < 0:  # what never ends is no comment
                    break
                after = close + len(end)
            text = source[m.end() : close].strip()
            if text:
                doc = text[0] == "*" and begin == "/*" if block else to_end in ("//", "#") and text[0] == to_end[0]
                first, last = place(p), place(after)
                if text := text[1:].strip() if doc and not block else text:
                    out.append((text, "doc" if doc else "block" if block else "line", first[0], last[0], first[1], last[1]))
            at = after
        elif mark in _REST:
            at = _REST[mark].match(source, m.end()).end()
        else:
            at = (source.find(mark, m.end()) + 1 or len(source) + 1) - 1 + len(mark)
    return out


def comments(files: DataFrame) -> DataFrame:
    """path, text, kind (line, block or doc), line, end_line, col, end_col: the comments of files (path, language, content).

    Marks inside strings are no comments; empty comments are left out, and so is one that never ends;
    ///, ## and /** make a doc comment. Columns count letters from 1; a comment ends before ``end_col``.
    """

    def run(frames: Iterator[pd.DataFrame]):
        for f in frames:
            rows = [(path, *c) for path, language, source in zip(f["path"], f["language"], f["content"], strict=True) for c in scanned(source, language)]
            yield pd.DataFrame(rows, columns=["path", "text", "kind", "line", "end_line", "col", "end_col"])

    rows = files.filter(F.col("language").isin(*COMMENTED) & F.col("content").isNotNull()).select("path", "language", "content")
    return rows.mapInPandas(run, "path string, text string, kind string, line int, end_line int, col int, end_col int")


def chapter_title(number: Column, reads: Column, edits: Column, runs: Column, tests: Column) -> Column:
    """What a chapter is about, told by how many tools of each sort it used."""
    turn = F.concat(F.lit("Turn "), number.cast("string"))
    title = F.when(reads + edits + runs == 0, F.when(number == 1, "Discussion").otherwise(turn))
    title = title.when((tests > 0) & (tests > F.floor(runs / 2)) & (reads < edits) & (edits < runs), "Testing").when((reads > edits * 2) & (reads > runs), "Exploration")
    title = title.when((edits > reads) & (edits > runs), "Implementation").when((runs > reads) & (runs > edits), F.when(tests > F.floor(runs / 2), "Testing").otherwise("Execution"))
    return title.when((reads > 0) & (edits > 0), "Implementation").otherwise(turn)
