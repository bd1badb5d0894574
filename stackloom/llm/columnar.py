"""Whole-batch text work on Arrow buffers: words, hashes and windows of many texts at once, without a loop over rows.

A text column arrives as one run of UTF-8 bytes with offsets. Word classes of the operators are defined on ASCII
separators only, so every byte from 0x80 belongs to a word and the rules can be applied to bytes. Null texts are
read as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 2 << 20

_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def _mask(separators: bytes) -> np.ndarray:
    out = np.ones(256, bool)
    out[np.frombuffer(separators, np.uint8)] = False
    return out


#: True for the bytes of words: anything but white space, and lower-case letters, digits and non-ASCII.
WORD_BY_SPACE, WORD_BY_ALNUM = _mask(_SPACE), _mask(_NOT_ALNUM)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BASES = {0: 0x9E3779B97F4A7C15, 1: 0xD1342543DE82EF95}


@lru_cache(maxsize=8)
def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64 for i below n."""
    r = BASES[seed]
    inverse = pow(r, -1, 1 << 64)
    up, down = np.full(n, r, U64), np.full(n, inverse, U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(12, int(n).bit_length()), seed)


@lru_cache(maxsize=4)
def _byte_values(lower: bool, seed: int) -> np.ndarray:
    codes = LOWER if lower else np.arange(256, dtype=np.uint8)
    return mix64((codes.astype(U64) + U64(1)) * U64(BASES[seed]))


class Texts:
    """The texts of an Arrow string array as one byte array and offsets; nulls are empty texts."""

    def __init__(self, array: pa.Array | pa.ChunkedArray):
        if isinstance(array, pa.ChunkedArray):
            array = array.combine_chunks()
            array = array if isinstance(array, pa.Array) else pa.concat_arrays(array.chunks) if array.chunks else pa.array([], pa.large_string())
        array = array.cast(pa.large_string())
        if array.null_count:
            array = array.fill_null("")
        n, (_, offsets, data) = len(array), array.buffers()
        at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + n + 1] if n else np.zeros(1, np.int64)
        self.offsets = at - at[0]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.bytes = whole[at[0] : at[-1]]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.bytes[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def rows(self, first: int, end: int) -> Texts:
        """The texts from number `first` to before `end`."""
        out = object.__new__(Texts)
        at = self.offsets[first : end + 1]
        out.offsets, out.bytes = at - at[0], self.bytes[at[0] : at[-1]]
        return out

    def n_chars(self) -> np.ndarray:
        """Code points of each text."""
        heads = np.concatenate(([0], np.cumsum((self.bytes & 0xC0) != 0x80)))
        return heads[self.offsets[1:]] - heads[self.offsets[:-1]]


class Words:
    """Words of all texts in order: byte ranges, and `at`, where each text's words start."""

    def __init__(self, texts: Texts, word: np.ndarray, lower: bool = False):
        self.texts, self.lower = texts, lower
        data, offsets = texts.bytes, texts.offsets
        inside = (word[LOWER] if lower else word)[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            heads = offsets[:-1][offsets[:-1] < offsets[1:]]
            tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            first[heads], last[tails] = inside[heads], inside[tails]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes, of the lower-case ones if lower is set."""
        data = self.texts.bytes
        if not len(self.starts):
            return np.zeros(0, U64)
        up, down = powers(len(data), seed)
        sums = np.empty(len(data) + 1, U64)
        sums[0] = 0
        np.cumsum(_byte_values(self.lower, seed)[data] * up[: len(data)], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix64(h + (self.ends - self.starts).astype(U64) * U64(0xA0761D6478BD642F))

    def windows(self, h: np.ndarray, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(start words of the windows of k words that lie within one text, their hashes from word hashes h)."""
        n = len(h)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        up, down = powers(n, seed)
        sums = np.empty(n + 1, U64)
        sums[0] = 0
        np.cumsum(h * up[:n], out=sums[1:])
        room = np.repeat(self.at[1:], self.counts) - np.arange(n)
        starts = np.flatnonzero(room >= k)
        return starts, mix64((sums[starts + k] - sums[starts]) * down[starts] + U64(k))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that each piece has at most `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = Texts(batch.column(column)).offsets
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(row, end - row)
            row = end


def strings(values: list[str]) -> pa.Array:
    return pa.array(values, pa.string())
