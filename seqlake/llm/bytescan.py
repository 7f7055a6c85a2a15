"""Vectorised scans of text columns as UTF-8 bytes: blocks of documents, words, and rolling hashes.

Everything here works on one Arrow batch inside a task; a block of documents of some MB is held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one block holds, unless a single document is longer.
BLOCK_BYTES = 1 << 20

#: ASCII lower case; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space: space, and tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Word bytes of the decontamination: digits, letters, and all bytes of characters beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
_INVERSE = pow(_BASE, -1, 1 << 64)


class Block(NamedTuple):
    """Documents [first, last) of a batch: their bytes end to end, and where each begins (one more than documents)."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + max_bytes, "right")) - 1)
        yield Block(first, last, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
        first = last


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Maximal runs of word bytes within each document; doc counts from 0 in the block."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = is_word[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    here, before = inside[1:], inside[:-1]
    start = np.flatnonzero(here[:n] & (~before[:n] | first[:n]))
    end = np.flatnonzero(before & (~here | first))
    return Words(start, end, np.searchsorted(offsets, start, "right") - 1)


@lru_cache(maxsize=2)
def _powers(size: int, factor: int) -> np.ndarray:
    out = np.full(size, factor, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The powers 0 to n - 1 of the base of the rolling hash, modulo 2 ** 64."""
    size = 1 << max(21, int(n - 1).bit_length())
    return _powers(size, _INVERSE if inverse else _BASE)[:n]


@lru_cache(maxsize=4)
def byte_values(seed: int) -> np.ndarray:
    """A random odd number for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_sums(data: np.ndarray, seed: int = 1) -> np.ndarray:
    """Sums from which the hash of any substring follows by hash_ranges()."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(byte_values(seed)[data] * powers(len(data)), out=sums[1:])
    return sums


def hash_ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes in each range, the same wherever they stand."""
    return mixed((sums[end] - sums[start]) * powers(len(sums), inverse=True)[start])


def hash_runs(sums: np.ndarray, size: int) -> np.ndarray:
    """hash_ranges() of all runs of size bytes, in order."""
    return mixed((sums[size:] - sums[:-size]) * powers(len(sums), inverse=True)[: len(sums) - size])


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def window_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of size words; runs may cross documents, which the caller drops."""
    n = max(0, len(word_hashes) - size + 1)
    out = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        out = out * np.uint64(_BASE) + word_hashes[j : j + n]
    return mixed(out)
