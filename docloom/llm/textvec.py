"""Whole-text word and shingle vectors over Arrow string columns.

A text is handled as its UTF-8 bytes: a word is a run of bytes other than the
six ASCII blanks (0x20, 0x09-0x0D), which never occur inside a multi-byte code
point. Everything here is array arithmetic over slices of a record batch, so no
Python object is made for a word. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BLOCK = 1 << 14


def _table(base: int) -> np.ndarray:
    """base**i modulo 2**64 for i < _BLOCK."""
    return np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(_BLOCK - 1, base, np.uint64))])


_POWERS, _INVERSES = _table(_BASE), _table(_BASE_INVERSE)


def _steps(n: int, base: int) -> np.ndarray:
    """base**(_BLOCK * i) modulo 2**64, for as many blocks as n positions need."""
    step = np.full(n // _BLOCK + 1, pow(base, _BLOCK, 1 << 64), np.uint64)
    step[0] = 1
    return np.multiply.accumulate(step)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the public splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Slice:
    """Consecutive texts of a column: bytes, offsets (one more than texts) and lazily their words."""

    def __init__(self, first: int, buf: np.ndarray, offsets: np.ndarray):
        self.first, self.buf, self.offsets = first, buf, offsets
        self.n = len(offsets) - 1
        self._words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and for each text the index of its first word (one more than texts)."""
        if self._words is None:
            buf, off = self.buf, self.offsets
            solid = ~BLANK[buf]
            head, tail = solid.copy(), solid
            head[1:] &= ~solid[:-1]
            begin = off[:-1][off[:-1] < off[1:]]
            head[begin] = solid[begin]
            tail = solid.copy()
            tail[:-1] &= ~solid[1:]
            last = off[1:][off[:-1] < off[1:]] - 1
            tail[last] = solid[last]
            starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
            self._words = starts, ends, np.searchsorted(starts, off)
        return self._words

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
        """64-bit hashes of byte ranges, after lower-casing A-Z if asked."""
        return range_hashes(LOWER[self.buf] if lower else self.buf, starts, ends)


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges by their content alone; tables are of fixed size, however long the bytes."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    powers = (_steps(len(buf), _BASE)[:, None] * _POWERS).reshape(-1)[: len(buf)]
    np.cumsum(_BYTE_VALUE[buf] * powers, out=sums[1:])
    inverses = _steps(len(buf), _BASE_INVERSE)[starts // _BLOCK] * _INVERSES[starts % _BLOCK]
    return mix((sums[ends] - sums[starts]) * inverses + (ends - starts).astype(np.uint64))


def plain_column(column: pa.Array) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def slices(column: pa.Array, target: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a string column into runs of texts of about target bytes; one text is never cut."""
    column = plain_column(column)
    if not len(column):
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + target, "right")) - 1)
        yield Slice(i, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` consecutive values (over text bounds too; callers cut those)."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    n = len(hashes) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _U(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mix(out)


def text_sets(piece: Slice, width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: `width` words, all words as one where there are fewer, none without words."""
    starts, ends, bounds = piece.words()
    words = piece.hashes(starts, ends)
    shingles = windows(words, width)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(shingles[a : b - width + 1])
        elif b > a:
            whole = _U(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    whole = whole * _U(0xA0761D6478BD642F) + w
            yield mix(np.array([whole], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
