"""Vectorised helpers that run inside tasks on one Arrow batch of texts at a time.

Everything here is a small numpy function over bytes; distribution, grouping and joining stay with
Spark.  A batch is laid out as one byte array in which every text is followed by one space, so a
word or a window never runs from one text into the next.
"""

from __future__ import annotations

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: lower case, and a space for ASCII punctuation
PLAIN = LOWER.copy()
PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 0x20

_MASK = (1 << 64) - 1


def byte_values(seed: int) -> np.ndarray:
    """A 64-bit value for each byte, by the splitmix64 rule from ``seed``."""
    z = (np.arange(1, 257, dtype=np.uint64) + np.uint64(seed * 1000)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    z = z.astype(np.uint64, copy=True)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


class Rolling:
    """Hashes of any substrings of one byte array, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray, seed: int):
        base = (0xD1342543DE82EF95 + 2 * 0x5851F42D4C957F2D * seed) & _MASK | 1
        self.n = len(data)
        self.prefix = np.zeros(self.n + 1, np.uint64)
        self.power = powers(base, self.n)
        np.cumsum(byte_values(seed)[data] * self.power, out=self.prefix[1:])
        self.inverse = powers(pow(base, -1, 1 << 64), self.n)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end], with the length worked in."""
        at = np.minimum(start, max(self.n - 1, 0))
        raw = (self.prefix[end] - self.prefix[start]) * self.inverse[at]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def fixed(self, width: int) -> np.ndarray:
        """Hash of every window of ``width`` bytes."""
        return mix((self.prefix[width:] - self.prefix[:-width]) * self.inverse[: self.n - width + 1])


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; kept between batches, grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.ones(1, np.uint64)
        step = base
        while len(out) < max(n, 1 << 16):
            out = np.concatenate([out, out * np.uint64(step)])
            step = step * step & _MASK
        _POWERS[base] = have = out
    return have[:n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by doubling."""
    have, span = x, 1
    while span * 2 <= width:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    rest = width - span
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def layout(texts: list, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a batch, bytes replaced by ``table``; null texts are empty."""
    raw = [b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8) if raw else np.zeros(0, np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1].astype(np.int64)
    return (data if table is None else table[data]), starts, starts + sizes


class Words:
    """Words of a batch: where they start and end, whose they are, and a 64-bit hash of each."""

    def __init__(self, texts: list, table: np.ndarray | None = LOWER):
        self.data, self.starts, self.ends = layout(texts, table)
        gap = SPACES[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
        self.begin, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.starts, self.begin, "right") - 1
        self.n = len(self.begin)
        #: first word of each text, and one more at the end
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.hash = Rolling(self.data, 1).of(self.begin, self.end) if self.n else np.zeros(0, np.uint64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every n words in a row inside one text."""
        if self.n < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[n - 1 :] == self.doc[: self.n - n + 1])
        value = np.zeros(len(at), np.uint64)
        for k in range(n):
            value = mix(value * np.uint64(0x2545F4914F6CDD1D) + self.hash[at + k])
        return at, value
