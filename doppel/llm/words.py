"""Words of whole texts as 64-bit hashes, computed with numpy over the bytes of many texts at once.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D), lower-cased in A-Z. Its hash is a polynomial of its
bytes modulo 2**64, taken from running sums, and then mixed; two of n distinct words share a hash with a chance of about n**2 / 2**65.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(0, 2 ** 64, 256, np.uint64, endpoint=False)
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
_INVERSE = pow(_BASE, -1, 2 ** 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Spans:
    """Hashes of spans of bytes, from one running sum over all of them."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _power(_INVERSE, len(self.sums))[starts])

    def plain(self, length: int, starts: np.ndarray | None = None) -> np.ndarray:
        """Hashes of all spans of a length, or of those at some starts, whose upper bits are good and lower ones are not."""
        if starts is None:
            return (self.sums[length:] - self.sums[:-length]) * _power(_INVERSE, len(self.sums))[:max(0, len(self.sums) - length)]
        return (self.sums[starts + length] - self.sums[starts]) * _power(_INVERSE, len(self.sums))[starts]


class Words:
    """The words of some texts: `hashes` back to back, `counts` by text, `starts` and `ends` in `raw`, the joined bytes."""

    def __init__(self, texts: list[str] | list[bytes], lower: bool = True):
        parts = [t if isinstance(t, bytes) else t.encode("utf-8", "replace") for t in texts]
        raw = b" ".join(parts) + b" "
        self.raw = raw.translate(_LOWER) if lower else raw
        data = np.frombuffer(self.raw, np.uint8)
        space = _SPACE[data]
        edge = np.diff(space.astype(np.int8), prepend=1)
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(self.ends) > len(self.starts):
            self.ends = self.ends[-len(self.starts):] if len(self.starts) else self.ends[:0]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * _power(_INVERSE, len(data))[self.starts])
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        bounds = np.concatenate([[0], np.cumsum(size + 1)])
        self.counts = np.diff(np.searchsorted(self.starts, bounds))

    @property
    def docs(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def word(self, i: int) -> bytes:
        return self.raw[self.starts[i]:self.ends[i]]


def ngrams(hashes: np.ndarray, counts: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and how many each text has.

    With `short`, a text of fewer than n words, but some, has one: all its words.
    """
    first = np.cumsum(counts) - counts
    made = np.maximum(counts - n + 1, 0)
    total = int(made.sum())
    at = np.repeat(first - (np.cumsum(made) - made), made) + np.arange(total)
    out = np.zeros(total, np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(3) + hashes[at + j])
    if short and ((counts > 0) & (counts < n)).any():
        few = np.flatnonzero((counts > 0) & (counts < n))
        extra = np.zeros(len(few), np.uint64)
        for j in range(n - 1):
            more = counts[few] > j
            extra[more] = mix(extra[more] * np.uint64(3) + hashes[first[few[more]] + j])
        # Marked, so that a short text is not taken for part of a longer one.
        out = np.insert(out, np.cumsum(made)[few], mix(extra + np.uint64(1)))
        made = made + np.bincount(few, minlength=len(counts))
    return out, made
