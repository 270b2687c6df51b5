"""Words and shingles of texts as numpy arrays, for use inside Arrow tasks.

Texts stay the UTF-8 bytes that Arrow delivers. All functions work on a slice of
a bounded number of bytes (one longer text is a slice of its own), so the memory of a
task does not depend on the number of its rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Return freed memory to the machine, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # Another C library.
        pass


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


_powers_kept: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if not _powers_kept or len(_powers_kept[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        base = np.full(size, _ODD, np.uint64)
        inverse = np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
        base[0] = inverse[0] = 1
        _powers_kept[:] = [np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)]
    return _powers_kept[0][:n], _powers_kept[1][:n]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte span data[start:end]; equal spans hash alike."""
    n = len(data)
    powers, inverses = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_values()[data] * powers[:n], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Texts:
    """A slice of texts: their bytes one after another, and where each begins."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> Texts:
        """A-Z in lower case; other letters stay."""
        return Texts(_LOWER[self.data], self.offsets)


@dataclass
class Words:
    """Words of a slice: byte spans, and the index of the first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def texts(column: pa.Array) -> Texts:
    """The bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, places, values = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    if values is None or not len(offsets) or offsets[-1] == offsets[0]:
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]]
    return Texts(data, offsets - offsets[0])


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The rows of the batches in pieces of at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = texts(batch.column(column))
        start, n = 0, batch.num_rows
        while start < n:
            stop = int(np.searchsorted(whole.offsets, whole.offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), n)
            cut = whole.offsets[start : stop + 1]
            yield batch.slice(start, stop - start), Texts(whole.data[cut[0] : cut[-1]], cut - cut[0])
            start = stop
    give_back()


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes; a run ends where its text ends."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edges] = inside[edges]
    stops[edges[1:] - 1] = inside[edges[1:] - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def words(block: Texts) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text."""
    starts, ends = spans(~_SEPARATORS[block.data], block.offsets)
    return Words(starts, ends, np.searchsorted(starts, block.offsets))


def word_hashes(block: Texts, found: Words) -> np.ndarray:
    return hash_spans(block.data, found.starts, found.ends)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``k`` words in a row, the text of each, and the index of its first word.

    ``whole``: a text of fewer words (one at least) gives its whole sequence as one.
    """
    n, counts = len(hashes), np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    total = np.zeros(max(n - k + 1, 0), np.uint64)
    for i in range(k):
        total += mix(hashes[i : n - k + 1 + i] + np.uint64((i + 1) * _ODD & _MASK))
    good = text[: len(total)] == text[k - 1 :] if n >= k else np.zeros(0, bool)
    at = np.flatnonzero(good)
    out, of = mix(total[at]), text[at]
    if not whole:
        return out, of, at
    short = np.flatnonzero((counts > 0) & (counts < k))
    extra = np.zeros(len(short), np.uint64)
    for i in range(k - 1):
        has = counts[short] > i
        extra[has] += mix(hashes[first[short[has]] + i] + np.uint64((i + 1) * _ODD & _MASK))
    extra = mix(extra + np.uint64(0xD1B54A32D192ED03) * counts[short].astype(np.uint64))
    out, of, at = np.concatenate([out, extra]), np.concatenate([of, short]), np.concatenate([at, first[short]])
    order = np.argsort(of, kind="stable")
    return out[order], of[order], at[order]


def distinct(values: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each of ``n`` texts, ascending, and where each text's begin."""
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    values, of = values[keep], of[keep]
    return values, np.searchsorted(of, np.arange(n + 1))


def long_lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """64-bit numbers as a list column."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))
