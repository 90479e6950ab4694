"""Byte-level BPE by dynamic programming over byte prefixes, with exact appends and re-encoding near edits.

A vocabulary gives byte strings their ranks; merging joins, again and again, the neighbours whose joined
bytes have the least rank, the leftmost of equals. Two tokens are compatible if merging their joined bytes
from scratch ends in just these two. A sequence is the encoding exactly if all its neighbours are
compatible, so each prefix of the bytes has one valid last token, which is stored for every byte: of the
tokens that end there (found by an Aho-Corasick automaton), the one that is compatible with the last
token of what is before it. Following these back gives the ids.

The last token of a prefix depends on as many bytes and last tokens before it as the longest token has.
So appending only adds entries, and an edit keeps all entries before it and, once as many entries in a
row come out as they were, all after it. The pattern that cuts a text into matches looks one letter
ahead and never back: matches that end before an edit stay, and so do all after the first new cut
beyond the edit that was a cut before.

Defined cases: a null text counts as empty and gives no ids and empty bytes. Special tokens' strings are
ordinary text. Texts of any length are encoded whole, and decoding gives their UTF-8 bytes. Repeated rows
are each encoded, a null doc_id is kept, empty tables give no rows and extra columns don't matter.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import texts

#: Matches and pairs of tokens that a task remembers; then it starts anew.
REMEMBERED = 1 << 19
#: In these letters all Unicode tables agree; with others the library's own are asked.
COMMON = regex.compile(r"[\x00-ɏ‐-‧₠-₿]*")


class ByteBpe:
    """Encoder and decoder for a vocabulary file of ranks; ids are ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bytes = {i: token for token, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                found = self._halves(token, i)
                if found is None:  # no merge ends in it, so it is only found as a whole match
                    continue
                self.halves[i] = found
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.pattern, self.stand_in = regex.compile(pattern), None

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one."""
        for k in range(1, len(token)):
            a, b = self.ranks.get(token[:k], rank), self.ranks.get(token[k:], rank)
            if (k == 1 or a in self.halves) and (k == len(token) - 1 or b in self.halves) and a != rank and b != rank and self._apart(a, b, rank):
                return a, b
        return None

    def _apart(self, left: int, right: int, limit: float) -> bool:
        """Whether no merge across the border of two tokens comes before ``limit`` and the merges that made them.

        Those are undone from the border outwards, latest first. Of equal merges the one further left
        comes first.
        """
        a, b = left, right
        while True:
            if self.ranks.get(self.bytes[a] + self.bytes[b], limit) < limit:
                return False
            ra, rb = a if a in self.halves else -1, b if b in self.halves else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = min(limit, ra), self.halves[a][1]
            else:
                limit, b = min(limit, rb + 0.5), self.halves[b][0]

    def compatible(self, left: int, right: int) -> bool:
        known = self.fits.get(left << 32 | right)
        if known is None:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            known = self.fits[left << 32 | right] = self._apart(left, right, float("inf"))
        return known

    def fresh(self, data: bytes) -> list[int]:
        """The last token of every prefix."""
        last, fits = [-1] * len(data), self.fits.get
        for end, (token, n) in self.automaton.iter(data.decode("latin-1")):
            if last[end] < 0:
                if end < n:
                    last[end] = token  # the prefix is this token
                elif (left := last[end - n]) >= 0 and ((known := fits(left << 32 | token)) or known is None and self.compatible(left, token)):
                    last[end] = token
        return last

    def extend(self, data: bytes, last: list[int], old: list[int]) -> int:
        """Adds the last tokens of the prefixes of ``data`` that ``last`` lacks; returns how many were computed.

        ``old`` has the entries that the end of ``data`` had before an edit (none after an append); once
        they are seen to hold again they are taken over.
        """
        begin = now = len(last)
        base, same, tail = max(0, begin - self.longest + 1), 0, len(data) - len(old)
        last.extend([-1] * (len(data) - begin))
        for end, (token, n) in self.automaton.iter(data[base:].decode("latin-1")):
            end += base
            if end < begin:
                continue
            if end != now:  # the entry before is settled
                same = same + 1 if now >= tail and last[now] == old[now - tail] else 0
                now = end
                if same >= self.longest:
                    last[end:] = old[end - tail :]
                    return end - begin
            if last[end] < 0 and (end + 1 == n or (end >= n and last[end - n] >= 0 and self.compatible(last[end - n], token))):
                last[end] = token
        return len(data) - begin

    def follow(self, data: bytes, last: list[int]) -> list[int]:
        """Ids of a whole match from its stored last tokens; a match that is a token is that token."""
        if data in self.ranks:
            return [self.ranks[data]]
        ids, end = [], len(data) - 1
        while end >= 0:
            ids.append(last[end])
            end -= len(self.bytes[last[end]])
        return ids[::-1]

    def split(self, text: str, at: int = 0) -> Iterator[str]:
        """Matches of the pattern from ``at`` on."""
        if not COMMON.fullmatch(text):
            if self.stand_in is None:
                self.stand_in = self._newer()
            for kind, letters in self.stand_in:
                text_ = letters.sub(kind, text)
                if text_ != text:
                    yield from (text[m.start() : m.end()] for m in self.pattern.finditer(text_, at))
                    return
        yield from (m.group() for m in self.pattern.finditer(text, at))

    @staticmethod
    def _newer() -> list[tuple[str, regex.Pattern]]:
        """Letters and digits of a newer Unicode than the library's, to which these are neither; a symbol stands in for them."""
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        new: list[str] = []
        for kind in (r"\p{L}", r"\p{N}"):
            library = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
            new += sorted(set(regex.findall(kind, every)) - set(library.decode_bytes(library.encode_ordinary(every)).decode()))
        return [("☃", regex.compile("[" + "".join(map(regex.escape, new)) + "]"))] if new else []

    def match(self, m: str) -> tuple[bytes, bytes]:
        """(ids as 32-bit numbers, their bytes) of one match."""
        data = m.encode()
        ids = [self.ranks[data]] if data in self.ranks else self.follow(data, self.fresh(data))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        found = array("i", ids).tobytes(), self.decode(ids)
        if len(m) <= 64:
            self.known[m] = found
        return found

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """(ids as 32-bit numbers, their bytes) of a whole text."""
        known = self.known
        found = [known.get(m) or self.match(m) for m in (self.pattern.findall(text) if COMMON.fullmatch(text) else self.split(text))]
        return b"".join([x[0] for x in found]), b"".join([x[1] for x in found])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])


class Encoded:
    """A text with the stored last token of every byte prefix of its matches. ``computed`` counts the entries made so far."""

    def __init__(self, coder: ByteBpe, text: str, last: list[list[int]] | None = None, matches: list[str] | None = None):
        self.coder, self.text, self.computed = coder, text, 0
        self.matches = list(coder.split(text)) if matches is None else matches
        self.last = [self._fresh(m) for m in self.matches] if last is None else last

    def _fresh(self, m: str) -> list[int]:
        last = self.coder.fresh(m.encode())
        self.computed += len(last)
        return last

    @property
    def ids(self) -> list[int]:
        return [i for m, last in zip(self.matches, self.last, strict=True) for i in self.coder.follow(m.encode(), last)]

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces the letters from ``start`` up to ``stop`` by ``new``."""
        text = self.text[:start] + new + self.text[stop:]
        ends = np.cumsum([len(m) for m in self.matches]).tolist()
        keep = bisect_left(ends, start)
        at = ends[keep - 1] if keep else 0
        shift, sound, fresh, rest = len(text) - len(self.text), start + len(new), [], len(ends)
        for m in self.coder.split(text, at):
            fresh.append(m)
            at += len(m)
            k = bisect_left(ends, at - shift)
            if at >= sound and k < len(ends) and ends[k] == at - shift:
                rest = k + 1
                break
        if len(fresh) == 1 and rest == keep + 1:
            was, now = self.matches[keep].encode(), fresh[0].encode()
            most = min(len(was), len(now))
            head = next((i for i in range(most) if was[i] != now[i]), most)
            tail = next((i for i in range(most - head) if was[-1 - i] != now[-1 - i]), most - head)
            last = self.last[keep][:head]
            self.computed += self.coder.extend(now, last, self.last[keep][len(was) - tail :])
            found = [last]
        else:
            found = [self._fresh(m) for m in fresh]
        self.matches[keep:rest], self.last[keep:rest], self.text = fresh, found, text


_held: dict[tuple[str, str], ByteBpe] = {}


def coder_of(path: str, pattern: str) -> ByteBpe:
    """One encoder for each worker and file."""
    if (path, pattern) not in _held:
        _held[path, pattern] = ByteBpe(path, pattern)
    return _held[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded (their bytes)."""

    def run(batches: Iterator[pa.RecordBatch]):
        coder = coder_of(path, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows = [coder.encode(t) for t in texts(part.column(1))]
                sizes = [len(r[0]) // 4 for r in rows]
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join([r[0] for r in rows]), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), ids, pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded binary")


STORED = "struct<text: string, matches: array<int>, last: binary, computed: long, ids: array<int>>"


def stored(text: Column, path: str, pattern: str) -> Column:
    """What a text needs to be edited without being encoded anew: its matches' lengths and the last token of every byte prefix; and its ids."""
    return _changed(path, pattern)(F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<int>").alias("matches"), F.lit(None).cast("binary").alias("last")), F.lit(0), F.lit(0), text)


def edited(state: Column, start: Column, stop: Column, new: Column, path: str, pattern: str) -> Column:
    """A stored text with the letters from ``start`` up to ``stop`` replaced by ``new``; places beyond the text count as its end.

    ``computed`` tells for how many byte prefixes the last token was computed. Nulls are places 0 and empty texts.
    """
    return _changed(path, pattern)(F.struct(state["text"].alias("text"), state["matches"].alias("matches"), state["last"].alias("last")), start, stop, new)


def _changed(path: str, pattern: str):
    def one(coder: ByteBpe, text, matches, last, start, stop, new) -> dict:
        cut, done, at, flat = [], [], 0, np.frombuffer(last if last is not None else b"", np.int32)
        for n in matches if matches is not None else []:
            cut.append(text[at : at + n])
            at += n
            done.append(flat[: len(cut[-1].encode())].tolist())
            flat = flat[len(done[-1]) :]
        state = Encoded(coder, text or "", done, cut)
        start = min(max(0, start), len(state.text))
        state.edit(start, min(max(start, stop), len(state.text)), new)
        return {"text": state.text, "matches": [len(m) for m in state.matches], "last": np.array([t for own in state.last for t in own], np.int32).tobytes(), "computed": state.computed, "ids": state.ids}

    @F.pandas_udf(STORED)
    def run(state: pd.DataFrame, start: pd.Series, stop: pd.Series, new: pd.Series) -> pd.DataFrame:
        coder = coder_of(path, pattern)
        places = start.fillna(0).astype(int), stop.fillna(0).astype(int)
        rows = [one(coder, t, m, x, a, b, n or "") for t, m, x, a, b, n in zip(state["text"], state["matches"], state["last"], *places, new, strict=True)]
        return pd.DataFrame(rows, columns=["text", "matches", "last", "computed", "ids"])

    return run
