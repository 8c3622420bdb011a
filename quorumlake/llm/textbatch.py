"""Whole Arrow batches of text as numpy arrays: words, their hashes and rolling word-gram hashes.

All functions work on the UTF-8 bytes that Arrow hands over, so no Python string is made for a word.  A batch is cut
into slices of about ``SLICE_BYTES`` (one row at least), which bounds a task's memory whatever the batch size is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
#: Longer words are named by a digest: sums modulo 2**64 of bytes can be made to collide from 1024 bytes on.
LONG_WORD = 256

_SEED = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_of_seed(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash's base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = np.uint64(pow(int(_SEED), -1, 1 << 64))
        made = []
        for base in (_SEED, inverse):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


@dataclass(frozen=True)
class WordRule:
    """Which bytes belong to words, and the byte that stands for each byte."""

    is_word: np.ndarray
    fold: np.ndarray | None


def _rule(word_bytes: np.ndarray, fold_case: bool) -> WordRule:
    fold = np.arange(256, dtype=np.uint8)
    fold[ord("A") : ord("Z") + 1] += 32
    return WordRule(word_bytes, fold if fold_case else None)


def spaced_words(fold_case: bool = False) -> WordRule:
    """Words are runs without blanks and the control characters 9 to 13."""
    ok = np.ones(256, dtype=bool)
    ok[[0x20, *range(0x09, 0x0E)]] = False
    return _rule(ok, fold_case)


def letter_words() -> WordRule:
    """A-Z lower-cased; words are runs of digits, a-z and everything beyond ASCII."""
    ok = np.zeros(256, dtype=bool)
    ok[0x30:0x3A] = ok[0x61:0x7B] = ok[0x80:] = True
    return _rule(ok, True)


@dataclass(frozen=True)
class Texts:
    """Some rows of a batch: their bytes and where each begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


@dataclass(frozen=True)
class Words:
    """hash of each word; words ptr[i] to ptr[i+1] are of text i; start and end count bytes of the slice."""

    hash: np.ndarray
    ptr: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts())


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The rows of a text column in order; a null counts as an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        lo, hi = offsets[first], offsets[last]
        yield Texts(first, data[lo:hi], offsets[first : last + 1] - lo)
        first = last


def words(texts: Texts, rule: WordRule) -> Words:
    b = texts.data if rule.fold is None else rule.fold[texts.data]
    n = len(b)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64), none, none)
    inside = rule.is_word[b]
    begins = np.zeros(n + 1, dtype=bool)
    begins[texts.offsets[:-1]] = True
    begins = begins[:n]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | begins[1:]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begins[1:]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    power, inverse = _powers_of_seed(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    h = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG_WORD):
        h[i] = np.int64(digest64(b[start[i] : end[i]].tobytes())).view(np.uint64)
    return Words(h, np.searchsorted(start, texts.offsets).astype(np.int64), start, end)


def span_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes start to end of each span."""
    power, inverse = _powers_of_seed(len(b))
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    h = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG_WORD):
        h[i] = np.int64(digest64(b[start[i] : end[i]].tobytes())).view(np.uint64)
    return h


def roll(h: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of every k consecutive values, by doubling."""
    done, length, part, size = None, 0, h, 1
    with np.errstate(over="ignore"):
        while True:
            if k & 1:
                done = part if done is None else done[: len(part) - length] * np.uint64(pow(int(base), size, 1 << 64)) + part[length:]
                length += size
            k >>= 1
            if not k:
                return done
            part = part[:-size] * np.uint64(pow(int(base), size, 1 << 64)) + part[size:]
            size *= 2


def grams(h: np.ndarray, ptr: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one text, and the word index where each starts."""
    n = len(h)
    if n < k:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    base = np.uint64((int(_GRAM) + 2 * salt * 0x5851F42D4C957F2D) % (1 << 64))
    ends = np.repeat(ptr[1:], np.diff(ptr))[: n - k + 1]
    at = np.flatnonzero(np.arange(n - k + 1) + k <= ends)
    return mix(roll(h, k, base)[at] + np.uint64(k)), at


def sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    size, part = 1, key
    while size * 2 <= w:
        part = np.minimum(part[:-size], part[size:])
        size *= 2
    return part if size == w else np.minimum(part[: len(key) - w + 1], part[w - size :])


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie in a run of that length from one of the starts."""
    if not len(starts):
        return np.zeros(n, dtype=bool)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:n]) > 0


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def digest64(*parts: bytes) -> int:
    """A signed 64-bit digest of the parts."""
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(len(p).to_bytes(8, "little"))
        h.update(p)
    return int.from_bytes(h.digest(), "little", signed=True)


def digest128(part: bytes) -> bytes:
    return hashlib.blake2b(part, digest_size=16).digest()
