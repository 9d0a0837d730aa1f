"""Words of whole texts as numpy arrays over their UTF-8 bytes: starts, ends and hashes of a batch of texts."""

from __future__ import annotations

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def class_table(separators: str) -> np.ndarray:
    """True for bytes of words: all but the given ASCII characters. Bytes beyond ASCII are always of words."""
    out = np.ones(256, bool)
    out[[ord(c) for c in separators]] = False
    return out


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = class_table(" \t\n\x0b\x0c\r")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased
ALNUM = class_table("".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the finaliser of SplitMix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    """_MULT to the powers 0 .. n - 1, modulo 2**64."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (_powers[-1:] * _MULT)])
    return _powers


class Words:
    """Words of one text, A-Z lower-cased: ``start``, ``end`` (bytes) and ``hash`` (64 bits each)."""

    def __init__(self, text: str | bytes | None, of_word: np.ndarray):
        raw = text.encode() if isinstance(text, str) else text or b""
        self.bytes = _LOWER[np.frombuffer(raw, np.uint8)]
        inside = np.zeros(len(self.bytes) + 2, np.int8)
        inside[1:-1] = of_word[self.bytes]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.hash = self._hash()

    def __len__(self) -> int:
        return len(self.start)

    def _hash(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        offsets = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(offsets, size)
        values = self.bytes[np.repeat(self.start, size) + within].astype(np.uint64) + np.uint64(1)
        sums = np.add.reduceat(values * _power_table(int(size.max()))[within], offsets)
        return mix(sums + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def shingles(self, k: int) -> np.ndarray:
        """Hashes of all runs of k words, in order."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * _MULT + self.hash[j : j + n]
        return mix(h)

    def text(self, first: int, last: int) -> str:
        """Words first .. last - 1, joined by single spaces."""
        return b" ".join(self.bytes[a:b].tobytes() for a, b in zip(self.start[first:last], self.end[first:last], strict=True)).decode()


def shingle_set(text: str | None, k: int, of_word: np.ndarray = NOT_SPACE) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; of fewer words, the whole sequence as one."""
    w = Words(text, of_word)
    return np.unique(w.shingles(min(k, len(w)))) if len(w) else np.zeros(0, np.uint64)
