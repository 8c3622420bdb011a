"""Canonical length-limited Huffman codes for arrays of ids, decoded by table from many places of a block at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bits of the longest code; more if the ids need them.
LONGEST = 20
#: Ids between two checkpoints.
STEP = 128


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bits of each symbol's code, none over ``longest``, the sum of counts times bits as small as can be (package-merge).

    counts: how often each symbol occurs, all positive.  A symbol alone has one bit.
    """
    n = len(counts)
    if n < 2:
        return np.ones(n, dtype=np.int64)
    if n > 1 << longest:
        raise ValueError(f"{n} symbols need more than {longest} bits")
    order = np.argsort(counts, kind="stable")
    coins = counts[order].astype(float)
    levels, row = [], coins[:0]
    for _ in range(longest):
        both = np.concatenate([coins, row])
        by = np.argsort(both, kind="stable")
        levels.append(np.concatenate([[0], np.cumsum(by < n)]))  # coins among the first so many
        both = both[by][: len(both) // 2 * 2]
        row = both[0::2] + both[1::2]
    bits, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for coins_among in reversed(levels):
        own = int(coins_among[take])
        bits[order[:own]] += 1
        take = 2 * (take - own)
    return bits


@dataclass(frozen=True)
class Code:
    """The canonical code of some lengths: codes count up by length and then id, so the lengths say all."""

    bits: np.ndarray
    code: np.ndarray
    table: np.ndarray
    longest: int

    @classmethod
    def of(cls, ids: np.ndarray, lengths: np.ndarray) -> Code:
        longest, size = int(lengths.max(initial=1)), int(ids.max(initial=-1)) + 1
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        span = np.left_shift(np.int64(1), longest - lengths)
        begin = np.cumsum(span) - span
        bits, code, table = np.zeros(size, dtype=np.uint8), np.zeros(size, dtype=np.uint64), np.zeros(1 << longest, dtype=np.int64)
        bits[ids], code[ids] = lengths, begin >> (longest - lengths)
        table[: span.sum()] = np.repeat(ids << 8 | lengths, span)
        return cls(bits, code, table, longest)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream, first bit highest, and the bit where each STEP-th id begins."""
        length = self.bits[ids].astype(np.int64)
        at = np.cumsum(length) - length
        word, shift = at >> 5, (at & 31).astype(np.uint64)
        # a code has fewer bits than a word of 32, so each word has a first code and a code reaches into the next at most
        value = self.code[ids] << (np.uint64(64) - length.astype(np.uint64) - shift)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(len(first) + 1, dtype=np.uint64)
        out[:-1] += np.add.reduceat(value >> np.uint64(32), first)
        out[1:] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        end = int(at[-1] + length[-1])
        return out.astype(">u4").tobytes()[: (end + 7) // 8], at[::STEP]

    def decode(self, stream: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """n ids from the first checkpoint on; all checkpoints step through the table side by side."""
        word = np.frombuffer(stream + bytes(8 + -len(stream) % 4), dtype=">u4").astype(np.uint64)
        pair = word[:-1] << np.uint64(32) | word[1:]
        at, out = checkpoints.astype(np.int64), np.empty((STEP, len(checkpoints)), dtype=np.int64)
        down, most = np.uint64(64 - self.longest), len(pair) - 1
        for i in range(STEP):
            found = self.table[((pair[np.minimum(at >> 5, most)] << (at & 31).astype(np.uint64)) >> down).astype(np.int64)]
            out[i] = found >> 8
            at = at + (found & 255)
        return out.T.reshape(-1)[:n]
