"""Vectorised text kernels shared by the corpus operators.

A block is a run of whole texts, laid end to end as UTF-8 bytes. Words and their 64-bit hashes are
found for all texts of a block at once; no word crosses from one text into the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes of text hashed at once.
HASHED_BYTES = 1 << 18

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A random value for each byte; in FOLDED capital ASCII letters have those of the small ones.
EXACT = mix64(np.arange(256, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(0x5EED))
FOLDED = EXACT.copy()
FOLDED[65:91] = FOLDED[97:123]


def _class_table(separators: str) -> np.ndarray:
    table = np.ones(256, bool)
    table[[ord(c) for c in separators]] = False
    return table


#: Word bytes: ASCII letters and digits and every byte of a character outside ASCII.
ALNUM = _class_table("".join(chr(c) for c in range(128) if not chr(c).isalnum()))
#: Token bytes: all but blank and the five ASCII control characters that separate.
NON_SPACE = _class_table("\x20\x09\x0a\x0b\x0c\x0d")

_MULTIPLIER = 0x9E3779B97F4A7C55
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _grow(n: int) -> None:
    if len(_powers[0]) <= n:
        size = max(n + 1, HASHED_BYTES + (1 << 12))
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)


class Block:
    """Texts laid end to end. data: their bytes; bounds: where each starts, and the end."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds.astype(np.int64)
        self.n = len(bounds) - 1

    def words(self, member: np.ndarray = ALNUM) -> Words:
        """The maximal runs of bytes for which member holds, within each text."""
        flags = member[self.data]
        begin, end = flags.copy(), flags.copy()
        if len(flags):
            begin[1:] &= ~flags[:-1]
            end[:-1] &= ~flags[1:]
            full = self.bounds[1:] > self.bounds[:-1]
            first, last = self.bounds[:-1][full], self.bounds[1:][full] - 1
            begin[first], end[last] = flags[first], flags[last]
        return Words(self, np.flatnonzero(begin), np.flatnonzero(end) + 1)


class Words:
    """The words of a block in order. at: the index of each text's first word, and the end."""

    def __init__(self, block: Block, start: np.ndarray, end: np.ndarray):
        self.block, self.start, self.end = block, start, end
        self.at = np.searchsorted(start, block.bounds)
        self.per_text = np.diff(self.at)

    def text_of(self) -> np.ndarray:
        """The text's index in the block, for each word."""
        return np.repeat(np.arange(self.block.n), self.per_text)

    def bytes_of(self, i: int) -> bytes:
        """The word, ASCII letters in lower case."""
        return self.block.data[self.start[i] : self.end[i]].tobytes().lower()

    def hashes(self, fold: bool = True) -> np.ndarray:
        """A 64-bit hash of each word; with fold, ASCII letters count as lower case."""
        table, data = FOLDED if fold else EXACT, self.block.data
        out, low = np.empty(len(self.start), U64), 0
        while low < len(self.start):  # some bytes at a time, so that the sums stay in the cache
            at = int(self.start[low])
            high = max(low + 1, int(np.searchsorted(self.end, at + HASHED_BYTES, "right")))
            start, end = self.start[low:high] - at, self.end[low:high] - at
            n = int(end[-1])
            _grow(n)
            total = np.zeros(n + 1, U64)
            np.cumsum(table[data[at : at + n]] * _powers[0][:n], out=total[1:])
            out[low:high] = mix64((total[end] - total[start]) * _powers[1][start] + (end - start).astype(U64))
            low = high
        return out

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each run of size words, and how many each text has. A text with fewer words but one or more has
        one run of all its words; a text with none has none."""
        h, counts = self.hashes(), self.per_text
        if not len(h):
            return h, counts.astype(np.int64)
        padded = np.concatenate([h, np.zeros(size, U64)])
        left = np.repeat(self.at[1:], counts) - np.arange(len(h))  # words to the end of the text
        run = np.zeros(len(h), U64)
        for k in range(size):
            part = mix64(padded[k : k + len(h)] + U64(0x632BE59BD9B4E019 * (k + 1) % (1 << 64)))
            run = run * U64(0xD6E8FEB86659FD93) + (part if k == 0 else np.where(left > k, part, U64(0)))
        number = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
        rank = np.arange(len(h)) - np.repeat(self.at[:-1], counts)
        return mix64(run[rank < np.repeat(number, counts)]), number


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and bounds of a string array; a null is an empty text."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        column, width = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(buffers[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def cuts(bounds: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose bytes stay within most; a longer text stands alone."""
    low, n = 0, len(bounds) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + most, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """Blocks of a string array, with the range of rows each one holds."""
    data, bounds = string_parts(column)
    for low, high in cuts(bounds, most):
        yield low, high, Block(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
