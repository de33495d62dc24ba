"""Packing: best-fit decreasing of tokenised documents into windows of a fixed number of tokens.

Overlong documents are first cut into full windows. What is left of each document is placed, longest
first, into the open window with the least room that still holds it. Placement depends on lengths
alone, and there are at most ``window`` lengths, so the driver plans with a histogram: a segment tree
over remaining capacity answers "tightest open window", and pieces of equal length are placed in runs.
Spark tokenises, counts lengths, ranks pieces inside each length and joins them to the runs.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, numbered, staged
from .tokens import Vocabulary

#: Words of a memo (some 40 MB); a Python worker holds two at most. Changes speed only.
MEMO_WORDS = 160_000
#: Characters of texts that are encoded together, but for a text that is longer by itself. Changes memory only.
CHARS = 1_000_000
#: Runs of the plan that may be broadcast (48 bytes each); a longer plan is joined by shuffle.
BROADCAST_RUNS = 200_000

_PIECES = "uid long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


class _Memo(dict):
    """Ids of words as bytes; what is missing is taken from the memo before this one, or made."""

    def __init__(self, old: dict[str, bytes], make: Callable[[str], bytes]):
        super().__init__()
        self.old, self.make = old, make

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        self[word] = got
        return got


class _IdBytes:
    """Token ids of texts as little-endian 32-bit bytes, with a memo from word to the bytes of its ids.

    No pre-token of such a vocabulary reaches over white space, so white-space words are encoded once each, and a pre-token
    is a word of its own. The memo is bounded: a full one becomes the old one, and what is used again moves to the next.
    """

    _made: dict[str, _IdBytes] = {}

    def __init__(self, path: str):
        self.vocabulary = Vocabulary.at(path)
        self.words = _Memo({}, self._make)

    @classmethod
    def at(cls, path: str) -> _IdBytes:
        """One per Python worker and file, so that the memo serves all its tasks."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _make(self, word: str) -> bytes:
        # letters alone are one pre-token
        parts = [word] if word.isalpha() else self.vocabulary.parts(word)
        if len(parts) == 1:
            return _le32(self.vocabulary.encode_part(word))
        return b"".join([self.words[p] for p in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of all texts; one text's words are held at once."""
        out = []
        for text in texts:
            words = self.vocabulary.words(text)
            if words is None:
                out.append(_le32(self.vocabulary.encode([text])[0]))
                continue
            out.append(b"".join(map(self.words.__getitem__, words)))
            if len(self.words) > MEMO_WORDS:
                self.words = _Memo(dict(self.words), self._make)
        return out


def _le32(ids: list[int]) -> bytes:
    a = array("I", ids)
    if a.itemsize != 4:
        a = array("L", ids)
    return a.tobytes()


def _by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most 200 texts, and of about CHARS characters where texts are long."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_pylist()
    at, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held > CHARS or i - at == 199:
            yield batch.slice(at, i + 1 - at)
            at, held = i + 1, 0
    if at < len(sizes):
        yield batch.slice(at)


def pieces(docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """Tokenise and cut: one row per piece (uid, doc_id, start, length, ids_crc32, doc_tokens).

    A null text is an empty one, so every document has at least its end id. All pieces of a document
    but the last are full windows.
    """
    last = _le32([end_id])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _IdBytes.at(vocabulary)
        for batch in batches:
            for part in _by_size(batch):
                cols: list[list] = [[] for _ in range(6)]
                uids, docs_, texts = (part.column(i).to_pylist() for i in range(3))
                for uid, doc, b in zip(uids, docs_, ids.encode([t or "" for t in texts]), strict=True):
                    b += last
                    n = len(b) // 4
                    for s in range(0, n, window):
                        e = min(n, s + window)
                        for col, v in zip(cols, (uid, doc, s, e - s, zlib.crc32(b[4 * s : 4 * e]), n), strict=True):
                            col.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES)


class _Open:
    """Open windows by remaining capacity, over a segment tree that finds the tightest fit."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def _mark(self, r: int) -> None:
        i = r + self.size
        self.some[i] = bool(self.ranges[r])
        while i > 1:
            i //= 2
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def put(self, room: int, first: int, n: int) -> None:
        if n and room:
            self.ranges[room].append((first, n))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        got = self.ranges[room].pop()
        self._mark(room)
        return got

    def tightest(self, least: int) -> int | None:
        """The smallest room of an open window that is ``least`` or more."""
        i = least + self.size
        if self.some[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.some[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Runs (length, first_rank, end_rank, per_window, first_window, offset), and the number of windows.

    Pieces ``first_rank`` to ``end_rank`` of that length fill windows from ``first_window`` on,
    ``per_window`` in each from ``offset`` on.
    """
    open_, runs, windows = _Open(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = open_.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                first, n = windows, -(-left // per)
                windows += n
            else:
                per = room // length
                first, n = open_.take(room)
            full = min(n, left // per)
            if full:
                runs.append((length, rank, rank + full * per, per, first, capacity - room))
                open_.put(room - per * length, first, full)
            rank, left, first, n = rank + full * per, left - full * per, first + full, n - full
            if left and n:
                runs.append((length, rank, rank + left, left, first, capacity - room))
                open_.put(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            open_.put(room, first, n)
    return runs, windows


def pack(docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """Best-fit decreasing over all pieces: adds ``sequence_id`` and ``offset`` to ``pieces``.

    Null texts pack as one end id; rows with a null or repeated doc_id are documents of their own; an
    empty table gives an empty result. Sequences are to be padded to ``window``.
    """
    spark = docs.sparkSession
    cut = staged(pieces(docs, vocabulary, window, end_id), "packing")
    # at most ``window`` rows, whatever the input
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = best_fit_plan(counts, window)
    plan = spark.createDataFrame(runs, "length int, first_rank long, end_rank long, per_window long, first_window long, at long")
    if len(runs) <= BROADCAST_RUNS:
        plan = F.broadcast(plan)
    ranked = gapless_rank(cut, ["length"], ["uid", "start"], "rank", max(counts.values(), default=0)).alias("p")
    placed = ranked.join(plan.alias("r"), (F.col("p.length") == F.col("r.length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    inside = F.col("rank") - F.col("first_rank")
    return placed.select(
        "doc_id",
        "start",
        F.col("p.length").cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("first_window") + F.floor(inside / F.col("per_window"))).cast("long").alias("sequence_id"),
        (F.col("at") + inside % F.col("per_window") * F.col("p.length")).cast("long").alias("offset"),
    )
