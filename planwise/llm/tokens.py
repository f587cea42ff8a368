"""Words of many texts at once, as NumPy arrays.

Words are the runs of bytes other than 0x20 and 0x09-0x0D, which in UTF-8
never cut a character.  A word's key is a 64-bit polynomial hash of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from planwise.llm.common import mixed

CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORDS_ONLY = np.zeros(256, bool)  # separators that also drop ASCII punctuation and controls
WORDS_ONLY[[b for b in range(128) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20260).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept while no larger than a chunk needs."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 2 * CHUNK:
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def chunks(texts: Iterable[bytes], size: int = CHUNK) -> Iterable[list[bytes]]:
    """Runs of texts of about ``size`` bytes; a longer text is a run of its own."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > size:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def word_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit key for each of the words ``data[start:end]``."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(inverse(_BASE), n), out=sums[1:], dtype=np.uint64)
    return mixed((sums[end] - sums[start]) * powers(_BASE, n)[start])


class Tokens:
    """Word positions of a list of texts: ``start``, ``end`` in ``data``, ``first`` word and ``count`` of each text."""

    def __init__(self, texts: list[bytes], lower: bool, separators: np.ndarray = _SPACE):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.data = _LOWER[data] if lower else data
        space = separators[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        cut = np.searchsorted(self.start, self.bounds)
        self.first, self.count = cut[:-1], np.diff(cut)
        self.space = space

    def keys(self) -> np.ndarray:
        """A 64-bit key for each word."""
        return word_keys(self.data, self.start, self.end)

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the words of each text joined by one space, then 0xFF; and where each text starts."""
        keep = ~self.space
        keep[self.end] = True
        data = np.where(self.space, np.uint8(0x20), self.data)
        last = self.bounds[1:] - 1
        some = self.count > 0
        last[some] = self.end[(self.first + self.count - 1)[some]]
        keep[last] = True
        data[last] = 0xFF
        sizes = np.add.reduceat(keep, self.bounds[:-1], dtype=np.int64)
        return data[keep], np.cumsum(sizes) - sizes


def spans(keys: np.ndarray, width: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Rabin-Karp keys of every ``width`` consecutive word keys (texts not told apart)."""
    n = len(keys)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(keys * powers(inverse(base), n), out=sums[1:], dtype=np.uint64)
    return mixed((sums[width:] - sums[:n - width + 1]) * powers(base, n)[:n - width + 1])
