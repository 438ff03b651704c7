"""Words, hashes and shingles of whole texts, computed on blocks of UTF-8 bytes.

A word is a run of bytes other than space and the controls 9 to 13.  Every function
works on one block: the bytes of some whole texts laid end to end, with ``bounds``
holding where each text starts and the last one ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
"""Texts are taken together up to this many bytes; a longer text is a block of its own."""

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that equal inputs stay equal and others look random."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> _U64(shift)
        x *= _U64(factor)
    x ^= x >> _U64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base, and of its inverse modulo 2**64."""
    inverse = _U64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for factor in (_BASE, inverse):
        steps = np.full(size, factor, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    room = BLOCK_BYTES * 2
    if size <= room:
        return _powers(room)
    return _powers.__wrapped__(size)


@dataclass
class Block:
    """Some whole texts: their bytes, where each starts, and the row of the first."""

    data: np.ndarray
    bounds: np.ndarray
    first: int

    @property
    def texts(self) -> int:
        return len(self.bounds) - 1

    def prefix_hash(self) -> np.ndarray:
        """Running sums from which the hash of any slice follows."""
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODE[self.data] * powers(len(self.data) + 1)[0][: len(self.data)], out=sums[1:])
        return sums

    def slice_hash(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inverse = powers(len(self.data) + 1)[1]
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    def words(self, separators: np.ndarray = _WHITE) -> Words:
        inside = ~separators[self.data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        edges = self.bounds[:-1]
        before[edges[edges < len(inside)]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        lasts = self.bounds[1:] - 1
        after[lasts[(lasts >= 0) & (self.bounds[1:] > self.bounds[:-1])]] = False
        ends = np.flatnonzero(inside & ~after) + 1
        text = np.searchsorted(self.bounds[1:], starts, side="right")
        counts = np.bincount(text, minlength=self.texts)
        return Words(starts, ends, text, counts)


@dataclass
class Words:
    """Words of a block: byte ranges, the text each is in, and how many each text has."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    counts: np.ndarray


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of an Arrow column in order; null is an empty text."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if chunk.null_count:
            chunk = chunk.fill_null("")
        chunk = chunk.cast(pa.large_string())
        if not len(chunk):
            continue
        _, offsets, data = chunk.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        every = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        first = 0
        while first < len(chunk):
            last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), len(chunk))
            yield Block(every[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], first)
            first = last


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def shingles(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the text of each.

    A text of fewer words has one shingle, all its words; a text without words has none.
    """
    n = len(hashes)
    text = words.text
    out = np.zeros(max(n - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        out = out * _BASE + hashes[k : k + len(out)]
    whole = text[: len(out)] == text[size - 1 : size - 1 + len(out)]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if not len(short):
        return mix(out[whole]), text[: len(out)][whole]
    first = np.searchsorted(text, short)
    extra = np.zeros(len(short), dtype=np.uint64)
    for k in range(size - 1):
        there = words.counts[short] > k
        extra[there] = extra[there] * _BASE + hashes[first[there] + k]
    codes = mix(np.concatenate((out[whole], extra + words.counts[short].astype(np.uint64))))
    owners = np.concatenate((text[: len(out)][whole], short))
    order = np.argsort(owners, kind="stable")
    return codes[order], owners[order]
