"""BPE encoding and decoding by dynamic programming over prefixes.

A token sequence is the BPE encoding of a word exactly if every two neighbours in it are compatible,
that is, no merge across their border comes before the merges that built them. So every prefix of a
word has one last token: of the tokens that end there (found by an Aho-Corasick automaton over the
vocabulary's strings), the one that is compatible with the last token of what is left of it. Following
these back from the whole word gives the ids, with no merge loop.

Defined cases: a null text counts as empty and gives no ids and an empty decoded text. The special
tokens' strings in a text become their ids, as the tokenizers library does by default. Whole texts of
any length are encoded; nothing is truncated or padded. Repeated rows are each encoded, a null doc_id
is kept, empty tables give no rows and extra columns don't matter.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weir.llm.common import texts

#: Marks the end of a word, for vocabularies whose last symbols have a suffix. No byte's letter is this.
END = "\0"
#: Words and pairs of tokens that a task remembers; then it starts anew.
REMEMBERED = 1 << 20
#: Beyond these letters the library's own normaliser and splitter are asked, for its Unicode tables.
COMMON = regex.compile(r"[\x00-ɏ‐-‧₠-₿]*")


class Bpe:
    """Encoder and decoder for a vocabulary file of the tokenizers library (byte-level BPE with ends of words)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        model = d["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.strings = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in d["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            token = self.vocab[a + b]
            if token not in self.rank:
                self.rank[token], self.halves[token] = rank, (self.vocab[a], self.vocab[b])
            self.merged[self.vocab[a], self.vocab[b]] = rank
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            ended = bool(self.suffix) and token.endswith(self.suffix)
            s = token[: -len(self.suffix)] + END if ended else token
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[str, str, int]] = {}
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in letters]
        self.letters = {b: chr(b) for b in letters} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.library = None
        self.path = path

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay apart when their joined text is merged from scratch.

        The merges that built the two are undone from the border outwards, latest first; the pair at
        the border must never have a merge that would have come before the one just undone. Of equal
        merges the one further left comes first.
        """
        if (known := self.fits.get((left, right))) is not None:
            return known
        a, b, limit, good = left, right, float("inf"), True
        while True:
            if self.merged.get((a, b), float("inf")) < limit:
                good = False
                break
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                limit, a = ra, self.halves[a][1]
            else:
                limit, b = rb + 0.5, self.halves[b][0]
        if len(self.fits) >= REMEMBERED:
            self.fits.clear()
        self.fits[left, right] = good
        return good

    def encode_word(self, symbols: str) -> list[int]:
        """Ids of one word, given as letters of its bytes (with END where the vocabulary has ends of words)."""
        last: list[int] = [-1] * len(symbols)
        size: list[int] = [0] * len(symbols)
        for end, (token, n) in self.automaton.iter(symbols):
            if last[end] < 0 and (end + 1 == n or (last[end - n] >= 0 and self.compatible(last[end - n], token))):
                # Alone at the start, a token must be what its own letters merge to.
                if end + 1 > n or self.whole(token):
                    last[end], size[end] = token, n
        ids, end = [], len(symbols) - 1
        while end >= 0:
            ids.append(last[end])
            end -= size[end]
        return ids[::-1]

    def whole(self, token: int) -> bool:
        """Whether a token's own text merges to the token."""
        return token not in self.halves or self.compatible_halves(token)

    def compatible_halves(self, token: int) -> bool:
        known = self.fits.get((token, -1))
        if known is None:
            a, b = self.halves[token]
            # Its halves meet at the border untouched by any merge before the token's own.
            known = self.whole(a) and self.whole(b) and self._apart(a, b, self.rank[token])
            self.fits[token, -1] = known
        return known

    def _apart(self, a: int, b: int, own: int) -> bool:
        limit = float("inf")
        while True:
            rank = self.merged.get((a, b), float("inf"))
            if rank < limit and rank != own:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.halves[a][1]
            else:
                limit, b = rb + 0.5, self.halves[b][0]

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens, as the file's normaliser and splitter give them (not yet as bytes)."""
        if COMMON.fullmatch(text):
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            return self.words.findall(text.lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        back = {c: b for b, c in self.letters.items()}
        return [bytes(back[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def word(self, w: str) -> tuple[str, str, int]:
        """(ids joined by a space, tokens joined by a space, number of ids) of a word."""
        symbols = "".join([self.letters[b] for b in w.encode("utf-8", "surrogateescape")]) + (END if self.suffix else "")
        ids = self.encode_word(symbols)
        found = " ".join(map(str, ids)), " ".join([self.strings[i] for i in ids]), len(ids)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[w] = found
        return found

    def encode(self, text: str) -> tuple[str, str, int]:
        """The same for a whole text."""
        known, out = self.known, []
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        for p in parts:
            if p in self.special:
                out.append((str(self.special[p]), p, 1))
            else:
                out += [known.get(w) or self.word(w) for w in self.split(p)]
        return " ".join([x[0] for x in out]), " ".join([x[1] for x in out]), sum([x[2] for x in out])

    def decode(self, ids: list[int]) -> str:
        """Text of ids; these vocabularies name no decoder, so the tokens are joined by a space."""
        return " ".join([self.strings[i] for i in ids])


_held: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """One encoder for each worker and file."""
    if path not in _held:
        _held[path] = Bpe(path)
    return _held[path]


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by a space), decoded (their text)."""

    def run(batches: Iterator[pa.RecordBatch]):
        coder = bpe(path)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                rows = [coder.encode(t) for t in texts(part.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")
