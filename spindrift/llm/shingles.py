"""Hashes of words and of word windows over whole texts, in NumPy, for use inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the public splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_B, _BI = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_C, _CI = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 2**64)
_memo: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _memo.get(base)
    if have is None or len(have) < n:
        have = _memo[base] = _powers(base, max(n, 1 << 17))
    return have[:n]


def word_hashes(text: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word ``[^\\x20\\x09-\\x0D]+``; A-Z count as a-z if ``lower``."""
    raw = np.frombuffer(b" " + text + b" ", np.uint8)
    space = _SPACE.take(raw)
    edge = np.flatnonzero(space[1:] != space[:-1])
    if not len(edge):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start, end = edge[0::2] + 1, edge[1::2] + 1
    # white space counts 0, so that the sum from one word's start to the next one's is the word's
    total = np.add.reduceat((_LOWER if lower else _BYTE).take(raw) * _power(_B, len(raw)), start)
    return mix(total * _power(_BI, len(raw))[start] + (end - start).astype(np.uint64) * _ODD), start - 1


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """One hash for each window of ``length`` words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _power(_C, len(words)), dtype=np.uint64)))
    return mix((total[length:] - total[:-length]) * _power(_CI, n) + _U(length * int(_ODD) % 2**64))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


def words_of(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, list[int]]:
    """Word hashes of all texts one after the other, and where each text's begin, with the end of the last."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words, start = word_hashes(b"\n".join(raw), lower)
    first = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return words, np.searchsorted(start, first).tolist()


def shingle_sets(texts: list[str | None], length: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; with fewer words, of the whole sequence."""
    words, at = words_of(texts)
    windows, out = window_hashes(words, length), []
    for a, b in zip(at, at[1:], strict=False):
        if b - a >= length:
            out.append(distinct(windows[a : b - length + 1]))
        else:
            out.append(window_hashes(words[a:b], b - a) if b > a else words[:0])
    return out


def chunks(batch, rows: int = 64) -> Iterator:
    """Slices of an Arrow batch, small enough for the NumPy work on one to stay in the processor's cache."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
