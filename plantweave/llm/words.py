"""Words of many texts at once, and hashes of words and of runs of words, with NumPy.

Hashes are 64-bit and the same everywhere: a polynomial over bytes (over words for a
run), followed by a mixing step. Prefix sums give all of them in a few array passes.
"""

from __future__ import annotations

import functools

import numpy as np

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F


def byte_table(pattern_bytes: bytes) -> np.ndarray:
    """True for each byte that is part of a word."""
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(pattern_bytes, dtype=np.uint8)] = True
    return table


#: All but blank, tab, line feed, vertical tab, form feed and carriage return.
NOT_BLANK = byte_table(bytes(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D))
#: Digits, a-z and every byte of a non-ASCII character (texts are lower-cased first).
ALNUM = byte_table(bytes(b for b in range(256) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


@functools.lru_cache(maxsize=8)
def _tables(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    return _powers(base, 1 << bits), _powers(pow(base, -1, 1 << 64), 1 << bits)


def _power_pair(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _tables(base, max(18, int(n).bit_length()))
    return up[:n], down[:n]


#: Bytes, or words, hashed in one go; keeps the power tables in the cache.
_CHUNK = 1 << 17


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class Words:
    """Words of the texts ``raw[bounds[i]:bounds[i + 1]]``: starts, ends, document and first word of each document."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, table: np.ndarray):
        self.raw, self.bounds = raw, bounds
        inside = table[raw]
        left = np.empty_like(inside)
        left[:1] = False
        left[1:] = inside[:-1]
        heads = bounds[:-1]
        left[heads[heads < len(raw)]] = False
        right = np.empty_like(inside)
        right[-1:] = False
        right[:-1] = inside[1:]
        tails = bounds[1:-1]
        right[tails[tails > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~left)
        self.ends = np.flatnonzero(inside & ~right) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(bounds) - 1), self.counts)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """Hash of each word, or of its first ``most`` bytes."""
        word_ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        out = np.empty(len(self.starts), dtype=np.uint64)
        cuts = np.searchsorted(self.starts, np.arange(0, len(self.raw) + _CHUNK, _CHUNK))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            base, stop = self.starts[a], word_ends[b - 1]
            up, down = _power_pair(_BYTE_BASE, stop - base)
            total = np.zeros(stop - base + 1, dtype=np.uint64)
            np.cumsum((self.raw[base:stop].astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
            starts = self.starts[a:b] - base
            out[a:b] = mix((total[word_ends[a:b] - base] - total[starts]) * down[starts])
        return out

    def run_starts(self, n: int) -> np.ndarray:
        """Index of each word that begins a run of ``n`` words of one document."""
        m = max(0, len(self.doc) - n + 1)
        return np.flatnonzero(self.doc[:m] == self.doc[len(self.doc) - m :])


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words, by the index of its first word."""
    m = max(0, len(hashes) - n + 1)
    out = np.empty(m, dtype=np.uint64)
    up, down = _power_pair(_WORD_BASE, _CHUNK + n)
    total = np.zeros(_CHUNK + n + 1, dtype=np.uint64)
    for a in range(0, m, _CHUNK):
        part = hashes[a : a + _CHUNK + n - 1]
        k = len(part) - n + 1
        np.cumsum(part * up[: len(part)], out=total[1 : len(part) + 1])
        out[a : a + k] = mix((total[n : n + k] - total[:k]) * down[:k] + np.uint64(n))
    return out


def spread(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each hash, from its upper half."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def cut_sorted(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Bounds of the shards in a sorted hash array (``spread`` is monotone)."""
    return np.searchsorted(spread(hashes, shards), np.arange(shards + 1))
