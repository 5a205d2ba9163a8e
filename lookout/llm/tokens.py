"""Words of whole texts as arrays: Arrow columns in, 64-bit word hashes and byte spans out.

A text is never turned into Python strings here. Word classes are sets of bytes; every byte of a
multi-byte character (0x80 and above) belongs to a word, as in the contracts' character classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18  #: texts are worked through in blocks of whole texts of about this size
SPACES = bytes([0x20, *range(0x09, 0x0E)])
BASE = 0x9E3779B97F4A7C15 | 1
_random = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i < n."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 16)
        step = np.full(size, BASE, np.uint64)
        back = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        step[0] = back[0] = 1
        _powers, _inverse = np.multiply.accumulate(step), np.multiply.accumulate(back)
    return _powers[:n], _inverse[:n]


class Alphabet(NamedTuple):
    """Which bytes form words, and the code of each byte."""

    is_word: np.ndarray
    codes: np.ndarray


def alphabet(outside: bytes, lower: bool) -> Alphabet:
    """Words are runs of bytes not in ``outside``; with ``lower``, A-Z count as a-z."""
    is_word = np.ones(256, bool)
    is_word[list(outside)] = False
    codes = _random.copy()
    if lower:
        codes[65:91] = codes[97:123]
        is_word[65:91] = is_word[97:123]
    return Alphabet(is_word, codes)


PLAIN = alphabet(SPACES, lower=False)
LOWERED = alphabet(SPACES, lower=True)
ALNUM = alphabet(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]), lower=True)


class Texts(NamedTuple):
    """Consecutive texts: their bytes and the offsets of their starts (one more than texts)."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


class Words(NamedTuple):
    """Words of consecutive texts; ``first[i]`` is the index of text i's first word."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray


def texts(column: pa.Array) -> Texts:
    """The bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(data, offsets - offsets[0])


def blocks(batch: pa.RecordBatch, column: str, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The batch in slices of whole rows of about ``block_bytes`` of text each."""
    whole = texts(batch.column(column))
    start = 0
    while start < len(whole):
        stop = int(np.searchsorted(whole.offsets, whole.offsets[start] + block_bytes, "right")) - 1
        stop = min(max(stop, start + 1), len(whole))
        offsets = whole.offsets[start : stop + 1]
        yield batch.slice(start, stop - start), Texts(whole.data[offsets[0] : offsets[-1]], offsets - offsets[0])
        start = stop


def words(block: Texts, kind: Alphabet) -> Words:
    data, offsets = block
    inside = kind.is_word[data]
    n = len(data)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    starts[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(begin, offsets)
    if not len(begin):
        return Words(np.zeros(0, np.uint64), begin, end, first)
    up, down = powers(n)
    sums = np.cumsum(kind.codes[data] * up, dtype=np.uint64)
    before = np.where(begin > 0, sums[begin - 1], np.uint64(0))
    return Words(mix((sums[end - 1] - before) * down[begin]), begin, end, first)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive words; the caller drops runs across texts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * np.uint64(BASE) + hashes[j : j + n]
    return mix(out)


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of values; of consecutive words the same as ``windows``."""
    out = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        out = out * np.uint64(BASE) + rows[:, j]
    return mix(out)


def owners(first: np.ndarray) -> np.ndarray:
    """For each word the index of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def run_starts(first: np.ndarray, size: int) -> np.ndarray:
    """The word indices where a run of ``size`` words of one text starts."""
    total = int(first[-1])
    fits = np.ones(total, bool)
    last = np.repeat(first[1:], np.diff(first))
    fits &= np.arange(total) + size <= last
    return np.flatnonzero(fits)
