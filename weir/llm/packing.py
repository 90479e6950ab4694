"""Packing of tokenised documents into fixed windows, online and with bounded space.

Each task keeps ``open_windows`` windows. The part of a document that is longer than a window is cut
off as full windows; the rest goes to the open window that it fits best. When none fits, the fullest
window is filled with the head of the rest, emitted without padding, and the remainder opens a new
window in its place. At the end of its partition a task merges its leftover windows, in order of
fill, into full ones and keeps one short window at most. Those of ``TOGETHER`` partitions at a time are
shuffled, less than a window of each, and merged in the same way; what is left of them is cut into
powers of two, which need no padding. So memory is bounded by the open windows, one batch of documents
and the short windows of ``TOGETHER`` partitions; a lost task is run again over the same rows with the
same result.

Defined cases: a null text is empty and has only the end token. Repeated rows are packed as often as
they occur. A null doc_id is kept. Very long texts are encoded whole, those with very long runs of
white space by the tokenizers library. Empty tables give no rows; extra columns don't matter.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import texts, written

#: Runs of white space from which the pattern that cuts words would exhaust its stack.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{100000}")
#: Partitions whose last windows are merged in one task: 16 MB of ids at most.
TOGETHER = 2048
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def byte_bpe(path: str) -> Callable[[list[str]], Iterator[np.ndarray]]:
    """Ids as the tokenizers library gives them for a byte-level BPE file; its special strings become their own ids.

    The vocabulary is read from the file; the merging itself is done by tiktoken, several times as
    fast, which takes the same vocabulary by rank.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocab = {bytes(to_byte[c] for c in t): i for t, i in d["model"]["vocab"].items()}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    enc = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=vocab, special_tokens={})
    special = {t["content"]: t["id"] for t in d["added_tokens"]}
    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")")

    def library(text: str) -> list[int]:
        whole = Tokenizer.from_file(path)
        whole.no_truncation()
        whole.no_padding()
        return whole.encode(text, add_special_tokens=False).ids

    def encode(batch: list[str]) -> Iterator[np.ndarray]:
        for text in batch:
            if LONG_SPACE.search(text):
                yield np.array(library(text), np.uint32)
                continue
            parts = cut.split(text) if any(s in text for s in special) else [text]
            ids = [i for p in parts for i in ([special[p]] if p in special else enc.encode_ordinary(p))]
            yield np.array(ids, np.uint32)

    return encode


class Packer:
    """Windows of one task. ``emit(sequence, pieces)`` gets each finished window; a piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, window: int, open_windows: int, emit: Callable[[list], None]):
        self.window, self.most, self.emit = window, open_windows, emit
        self.open: list[tuple[int, int, list]] = []  # (fill, number, pieces), ordered by fill
        self.number = 0

    def add(self, doc, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.window:
            self.emit([(doc, at, ids[at : at + self.window], n)])
            at += self.window
        if at < n:
            self._place(doc, at, ids[at:], n)

    def _place(self, doc, start: int, ids: np.ndarray, n: int) -> None:
        k = bisect.bisect_right(self.open, self.window - len(ids), key=lambda w: w[0]) - 1  # the fullest in which it fits
        if k < 0 and len(self.open) >= self.most:
            fill, _, pieces = self.open.pop()
            room = self.window - fill
            self.emit([*pieces, (doc, start, ids[:room], n)])
            start, ids = start + room, ids[room:]
        fill, number, pieces = self.open.pop(k) if k >= 0 else (0, self.number, [])
        self.number += k < 0
        fill, pieces = fill + len(ids), [*pieces, (doc, start, ids, n)]
        if fill == self.window:
            self.emit(pieces)
        else:
            bisect.insort(self.open, (fill, number, pieces), key=lambda w: w[:2])

    def finish(self) -> list:
        """Merges what is left into full windows; returns the pieces of the last one, if it is short."""
        left = [p for _, _, pieces in reversed(self.open) for p in pieces]
        self.open = []
        *full, rest = cut(left, [self.window] * (sum(len(p[2]) for p in left) // self.window))
        for own in full:
            self.emit(own)
        return rest


def cut(pieces: list, sizes: list[int]) -> list[list]:
    """The pieces one after the other, dealt into sequences of the given sizes and one more for what remains."""
    out, own, room, sizes = [], [], 0, iter(sizes)
    room = next(sizes, None)
    for doc, start, ids, n in pieces:
        while room is not None and len(ids) >= room:
            out.append([*own, (doc, start, ids[:room], n)])
            start, ids, own = start + room, ids[room:], []
            room = next(sizes, None)
        if len(ids):
            own.append((doc, start, ids, n))
            room = None if room is None else room - len(ids)
    return [*out, own]


def powers(total: int, window: int) -> list[int]:
    """Full windows, then powers of two."""
    return [window] * (total // window) + [1 << b for b in reversed(range(window.bit_length())) if (total % window) >> b & 1]


def pack(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], Iterator[np.ndarray]]], window: int = 2048, end: int | None = 1, open_windows: int = 64) -> DataFrame:
    """One row per piece; ``ids`` are little-endian unsigned 32-bit numbers. ``encoder()`` is called once in each task."""

    def run(batches):
        encode, done = encoder(), []
        base, sequences = TaskContext.get().partitionId() << 40, 0

        def emit(pieces, last=False):
            nonlocal sequences
            at = 0
            for doc, start, ids, n in pieces:
                done.append((doc, start, len(ids), ids.tobytes(), n, base + sequences, at, last))
                at += len(ids)
            sequences += 1

        def flush():
            cols = list(zip(*done, strict=True))
            done.clear()
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "last"])

        packer = Packer(window, open_windows, emit)
        tail = np.array([] if end is None else [end], np.uint32)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                for doc, ids in zip(part.column(0).to_pylist(), encode(texts(part.column(1))), strict=True):
                    packer.add(doc, np.concatenate([ids, tail]))
                if done:
                    yield flush()
        emit(packer.finish(), True)
        if done:
            yield flush()

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["sequence_id", "offset"])
        docs_ = [None if pd.isna(d) else int(d) for d in frame["doc_id"]]
        pieces = [(d, start, np.frombuffer(ids, np.uint32), n) for d, start, ids, n in zip(docs_, frame["start"], frame["ids"], frame["doc_tokens"], strict=True)]
        rows = []
        for k, own in enumerate(cut(pieces, powers(int(frame["length"].sum()), window))):
            at = 0
            for doc, start, ids, n in own:
                rows.append((doc, start, len(ids), ids.tobytes(), n, (1 << 62) + (int(key[0]) << 40) + k, at))
                at += len(ids)
        return pd.DataFrame(rows, columns=[c for c in frame.columns if c not in ("last", "together")]).astype({"doc_id": "Int64"})

    packed = written(docs.select("doc_id", "text").mapInArrow(run, SCHEMA + ", last boolean"))
    short = packed.filter(F.col("last")).withColumn("together", F.expr(f"shiftright(sequence_id, 40) div {TOGETHER}"))
    return packed.filter(~F.col("last")).drop("last").unionByName(short.groupBy("together").applyInPandas(merge, SCHEMA))
