"""Word hashes of whole texts in numpy, for shingles and windows.

A word's hash is a polynomial over its bytes (each byte mapped to a random
64-bit number) in arithmetic modulo 2**64, taken from prefix sums, so that one
pass over the bytes of many texts hashes all their words; a mixing step
follows.  Bytes are handled in blocks, so memory stays bounded for texts of
any length.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
#: Bytes of a block.
BLOCK = 1 << 20


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n + n // 2, b, dtype=np.uint64))])
                                  for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_POWERS = Powers(_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    white = _WHITE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]])))
    start, end = edge[::2], edge[1::2]
    up, down = _POWERS(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[:len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start, end


def word_hashes(texts: list[str | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of words of each text."""
    joined = b" ".join([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    lengths = np.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], dtype=np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    raw = np.frombuffer(joined, dtype=np.uint8)
    if lower:
        raw = _LOWER[raw]
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw) and not _WHITE[raw[end]]:  # to the next white space, a window at a time
            found = np.flatnonzero(_WHITE[raw[end:end + BLOCK]])
            end = end + int(found[0]) if len(found) else min(len(raw), end + BLOCK)
        h, s, _ = _block_hashes(raw[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    first = np.searchsorted(np.concatenate(starts), begin)
    every = np.concatenate(hashes)
    return every, np.diff(np.concatenate([first, [len(every)]]))


_SHINGLE = [np.uint64(x | 1) for x in _rng.integers(0, 1 << 63, 64, dtype=np.uint64).tolist()]


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct ``words``-word shingles; of a shorter text the whole sequence
    is one; a text without words has none."""
    h, n = word_hashes(texts, lower=True)
    size = max(0, len(h) - words + 1)
    rolled = np.zeros(size, dtype=np.uint64)
    for k in range(words):
        rolled += h[k:k + size] * _SHINGLE[k]
    rolled = mix(rolled + np.uint64(words))
    out, at = [], 0
    for k in n.tolist():
        if k >= words:
            out.append(np.unique(rolled[at:at + k - words + 1]))
        elif k:
            whole = np.uint64(k)
            with np.errstate(over="ignore"):
                for i in range(k):
                    whole = whole + h[at + i] * _SHINGLE[i]
            out.append(mix(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at += k
    return out
