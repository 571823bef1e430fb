"""Words, shingles and their 64-bit hashes for whole Arrow batches of text, computed on the UTF-8 bytes without a loop over words.

A word is a run of characters other than space and the characters 9 to 13; both sets are ASCII, so bytes suffice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, BASE)]))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits of x (splitmix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each text starts, with the end; a null text is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return data, at - at[0]


class Words:
    """starts, ends: byte positions of all words; first: number of the first word of each text, with the end."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.at = text_bytes(column)
        if lower:
            self.data = LOWER[self.data]
        n, self.inside = len(self.data), ~SPACE[self.data]
        begins = self.inside.copy()
        begins[1:] &= ~self.inside[:-1]
        edges = self.at[(self.at > 0) & (self.at < n)]
        begins[edges] = self.inside[edges]
        finals = self.inside.copy()
        finals[:-1] &= ~self.inside[1:]
        finals[edges - 1] = self.inside[edges - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(finals) + 1
        self.first = np.searchsorted(self.starts, self.at)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial of its bytes, mixed with its length."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        length = self.ends - self.starts
        before = np.concatenate([[0], np.cumsum(length)[:-1]])
        place = np.arange(length.sum()) - np.repeat(before, length)
        value = (self.data[self.inside].astype(np.uint64) + np.uint64(1)) * powers(int(length.max()))[place]
        return mix(np.add.reduceat(value, before) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word windows, text by text, and where each text's begin, with the end. A text of fewer words has one, of its whole sequence; one without words has none."""
        h = self.hashes()
        sizes = np.where(self.counts >= n, self.counts - n + 1, np.minimum(self.counts, 1))
        first = np.concatenate([[0], np.cumsum(sizes)])
        place = np.repeat(self.first[:-1] - first[:-1], sizes) + np.arange(first[-1])
        many = np.repeat(np.minimum(self.counts, n), sizes)
        s = np.zeros(len(place), np.uint64)
        for k in range(n):
            has = many > k
            s[has] = mix(s[has] * np.uint64(3) + h[place[has] + k])
        return mix(s + many.astype(np.uint64)), first
