"""Words of many texts at once, in numpy: boundaries, 64-bit hashes, memoised codes.

A hash of bytes s..e is a polynomial modulo 2**64, taken from prefix sums and
then mixed, so that the hashes of all words (or of all windows) of a batch of
texts cost a few passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

BASE = 0x9E3779B97F4A7C15
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (a multiply-shift finaliser)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


class Rolling:
    """Prefix sums over one byte string; span(s, e) hashes its parts."""

    _NONE: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))
    _powers = _NONE

    @classmethod
    def forget(cls) -> None:
        """Lets the powers go, 16 bytes for each byte of the longest text so far."""
        cls._powers = cls._NONE

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        if len(Rolling._powers[0]) <= n:
            size = max(1 << 20, 1 << (n + 1).bit_length())
            both = []
            for base in (BASE, pow(BASE, -1, 1 << 64)):
                p = np.full(size, U(base))
                p[0] = 1
                both.append(np.cumprod(p, dtype=U))
            Rolling._powers = (both[0], both[1])
        self.up, self.down = Rolling._powers
        self.sums = np.zeros(n + 1, U)
        terms = raw.astype(U)
        terms += U(1)
        terms *= self.up[:n]
        np.cumsum(terms, out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = self.sums[end] - self.sums[start]
        x *= self.down[start]
        x += (end - start).astype(U) << U(56)
        return mix(x)


def bounds(raw: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that inner (256 booleans) allows."""
    flags = np.zeros(len(raw) + 2, np.int8)
    flags[1:-1] = inner[raw]
    edge = np.diff(flags)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def joined(texts: list[bytes], gap: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one array, each followed by gap, and where each begins."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(gap) for t in texts], out=at[1:])
    return np.frombuffer(gap.join([*texts, b""]), np.uint8), at


def ragged(offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices offset[i] .. offset[i]+length[i]-1, one after another."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    return np.repeat(offset - before, length) + np.arange(total)


class CodeStore:
    """Memo from a word's hash to its codes, held in flat arrays.

    learn(words) gives, for words that are new, their codes one after another
    and how many each has. When limit words are held, the memo starts afresh,
    which bounds its memory.
    """

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int):
        self.learn, self.limit = learn, limit
        self.reset()

    def reset(self) -> None:
        self.slots: dict[int, int] = {}
        self.codes = np.zeros(1 << 16, np.int64)
        self.offset, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _room(self, name: str, need: int) -> None:
        old = getattr(self, name)
        if need > len(old):
            new = np.zeros(max(need, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def slots_of(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """For each word its slot in offset and length."""
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.slots) + len(keys) > self.limit:
            self.reset()
        listed = keys.tolist()
        found = list(map(self.slots.get, listed))
        new = [i for i, s in enumerate(found) if s is None]
        if new:
            view = raw.tobytes()
            at = first[new]
            words = list(map(view.__getitem__, map(slice, start[at].tolist(), end[at].tolist())))
            codes, counts = self.learn(words)
            n, base = len(self.slots), self.used
            self._room("codes", base + len(codes))
            self._room("offset", n + len(new))
            self._room("length", n + len(new))
            self.codes[base : base + len(codes)] = codes
            self.used += len(codes)
            self.offset[n : n + len(new)] = base + np.cumsum(counts) - counts
            self.length[n : n + len(new)] = counts
            for k, i in enumerate(new, n):
                self.slots[listed[i]] = found[i] = k
        return np.array(found, np.int64)[inverse.ravel()]
