"""Words and word n-grams of many texts at once, as 64-bit hashes in numpy arrays.

A word is a maximal run of characters other than blank, tab, line feed, vertical tab,
form feed and carriage return. All of these are single bytes in UTF-8, so bytes are
scanned. Hashes do not depend on the process, the machine or the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that changes about half the bits for any change."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class WordHasher:
    """Hashes the words of texts; tables are made once per task."""

    def __init__(self, lower: bool):
        codes = np.arange(256)
        upper = (codes >= 65) & (codes <= 90)
        self.space = (codes == 32) | ((codes >= 9) & (codes <= 13))
        folded = np.where(upper & lower, codes + 32, codes).astype(np.uint64)
        self.value = mix(folded * _U(_ODD) + _U(1))
        self.power = self._powers(_ODD)
        self.inverse = self._powers(pow(_ODD, -1, 1 << 64))
        self.lower = lower

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        steps = np.full(BLOCK + 1, base, dtype=np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    def _block(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, starts and ends (in bytes) of the words of at most ``BLOCK`` bytes."""
        codes = np.frombuffer(data, dtype=np.uint8)
        gap = np.ones(len(codes) + 2, dtype=np.int8)
        gap[1:-1] = self.space[codes]
        edges = np.flatnonzero(np.diff(gap))
        starts, ends = edges[0::2], edges[1::2]
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(self.value[codes] * self.power[: len(codes)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.inverse[starts]
        return mix(hashes + (ends - starts).astype(np.uint64) * _U(_ODD)), starts, ends

    def _giant(self, data: bytes) -> np.ndarray:
        """The hash of one word longer than a block."""
        folded = data.lower() if self.lower else data  # bytes.lower() folds A-Z only
        return np.frombuffer(hashlib.blake2b(folded, digest_size=8).digest(), dtype=np.uint64)

    def long_text(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`_block`, for any length: cut at white space, a block at a time."""
        parts, at = [], 0
        while at < len(data):
            end = min(at + BLOCK, len(data))
            if end < len(data):
                cut = end
                while cut > at and not self.space[data[cut - 1]]:
                    cut -= 1
                if cut == at:  # a word longer than a block
                    while end < len(data) and not self.space[data[end]]:
                        end += 1
                    parts.append((self._giant(data[at:end]), np.array([at]), np.array([end])))
                    at = end
                    continue
                end = cut
            hashes, starts, ends = self._block(data[at:end])
            parts.append((hashes, starts + at, ends + at))
            at = end
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(p) for p in zip(*parts))

    def texts(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """``(index, hashes, starts, ends)`` of every text, in order; short ones share a pass."""
        group: list[bytes] = []
        first = size = 0
        for k, text in enumerate(texts):
            if len(text) + 1 > BLOCK // 4:
                yield from self._together(first, group)
                yield (k, *self.long_text(text))
                group, first, size = [], k + 1, 0
                continue
            if size + len(text) + 1 > BLOCK:
                yield from self._together(first, group)
                group, first, size = [], k, 0
            group.append(text)
            size += len(text) + 1
        yield from self._together(first, group)

    def _together(self, first: int, group: list[bytes]) -> Iterator[tuple]:
        if not group:
            return
        hashes, starts, ends = self._block(b" ".join(group))
        offsets = np.cumsum([0] + [len(t) + 1 for t in group])
        cuts = np.searchsorted(starts, offsets)
        for k in range(len(group)):
            part = slice(cuts[k], cuts[k + 1])
            yield first + k, hashes[part], starts[part] - offsets[k], ends[part] - offsets[k]


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every ``n`` words in a row; with fewer words, of all of them as one."""
    width = min(n, len(words))
    if width == 0:
        return np.zeros(0, np.uint64)
    count = len(words) - width + 1
    total = np.full(count, width, dtype=np.uint64)
    for k in range(width):
        total = total * _U(_ODD) + words[k : k + count]
    return mix(total)


def set_key(values: np.ndarray) -> int:
    """A 64-bit key of a set of hashes, the same for equal sets."""
    with np.errstate(over="ignore"):
        a = mix(values ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        b = mix(values ^ _U(0x14057B7EF767814F)).sum(dtype=np.uint64)
        key = mix(np.array([a * _U(3) ^ (b << _U(1)) ^ _U(len(values))], dtype=np.uint64))
    return int(key.view(np.int64)[0])
