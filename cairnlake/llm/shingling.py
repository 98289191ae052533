"""Word shingles as sorted sets of 64-bit hashes, for many texts at once.

A word is ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, in UTF-8. Its hash is a polynomial over its bytes, taken for all
words of a block as differences of running sums, and mixed with its length; words of more than ``LONG`` bytes are hashed
one by one with xxh3. The hash of a word doesn't depend on where it stands.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .common import mix

BLOCK = 1 << 20
LONG = 64
BASE = 0x9E3779B97F4A7C15 | 1
GOLD = np.uint64(0x9E3779B97F4A7C15)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    low, blank = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
    low[65:91] += 32
    blank[[0x20, 9, 10, 11, 12, 13]] = True
    return low, blank


LOW, BLANK = _tables()


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Hashes the words of byte strings; keeps the powers of BASE for one block."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)

    def block(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        data = LOW[np.frombuffer(raw, np.uint8)]
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~BLANK[data]
        step = np.diff(inside)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.grow(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], dtype=np.uint64, out=sums[1:])
        size = (end - start).astype(np.uint64)
        h = mix((sums[end] - sums[start]) * self.down[start] + size * GOLD) if len(start) else np.empty(0, np.uint64)
        for i in np.flatnonzero(end - start > LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
        return h, start

    def of(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first byte) of each word; blocks end at blanks."""
        found, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + BLOCK)
            while end < len(raw) and not BLANK[raw[end]]:
                end += 1
            h, start = self.block(raw[at:end])
            found.append((h, start + at))
            at = end
        if not found:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        return np.concatenate([h for h, _ in found]), np.concatenate([s for _, s in found])


def chained(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each position on."""
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * GOLD + h[i : len(h) - n + 1 + i])
    return out


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def shingle_sets(texts: list[str], n: int, words: Words) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; of the whole sequence if it has fewer words; empty without words."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws], dtype=np.int64)])
    h, start = words.of(b" ".join(raws))
    first = np.searchsorted(start, begins)  # of each text's words
    every = chained(h, n) if len(h) >= n else np.empty(0, np.uint64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        out.append(distinct(every[a : b - n + 1]) if b - a >= n else chained(h[a:b], b - a) if b > a else h[:0])
    return out
