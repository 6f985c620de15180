"""Vectorised word arithmetic on batches of texts, for use inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: UTF-8 bytes in one numpy batch; a longer text makes a batch of its own.
BATCH_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C55
_P_INV = pow(_P, -1, 1 << 64)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_P, _P_INV):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x))
        if n > 4 * BATCH_BYTES:  # do not keep what one very long text needed
            return made[0], made[1]
        _powers = (made[0], made[1])
    return _powers


class Words:
    """The words of a batch of texts: maximal runs of bytes that ``table`` marks.

    By default a word is a run without ASCII white space. start, end: byte
    offsets in ``data``; doc: index of the text; hash: 64 bits.
    """

    def __init__(self, texts: Sequence[bytes], table: np.ndarray = ~_SPACE):
        self.data = b"\n".join(texts) + b"\n"
        self.n_docs = len(texts)
        self.bytes = np.frombuffer(self.data, np.uint8)
        inside = np.zeros(len(self.bytes) + 1, bool)
        inside[1:] = table[self.bytes]
        self.start = np.flatnonzero(inside[1:] & ~inside[:-1])
        self.end = np.flatnonzero(inside[:-1] & ~inside[1:])
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.base = np.cumsum(sizes) - sizes
        self.doc = np.searchsorted(self.base, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts))
        self.first = np.cumsum(self.count) - self.count
        self._sums: np.ndarray | None = None

    def part_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end] for each pair."""
        power, inverse = _grown(len(self.bytes) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.bytes) + 1, np.uint64)
            np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * power[: len(self.bytes)], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * inverse[start] + (end - start).astype(np.uint64))

    @property
    def hash(self) -> np.ndarray:
        return self.part_hash(self.start, self.end)

    def code_points(self) -> np.ndarray:
        """For each byte offset, the code points before it in its text."""
        before = np.zeros(len(self.bytes) + 1, np.int64)
        np.cumsum((self.bytes & 0xC0) != 0x80, out=before[1:])
        return before

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, number of words) of the lines that have words; texts end lines too."""
        if not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        line = np.cumsum(self.bytes == 10)[self.start]
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        return first, np.diff(np.append(first, len(line)))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive entries (documents run together)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out = (out + words[j : len(words) - n + 1 + j]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out)


def batches(texts: Sequence[bytes], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of texts that hold about ``most`` bytes together."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def encoded(texts) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]
