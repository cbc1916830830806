"""Words and word shingles of many texts at once, as 64-bit hashes, inside Arrow tasks.

A word is a run of bytes other than space and the control characters 9 to 13, with A-Z lower-cased. All
functions work on one slice of an Arrow column of texts; a null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The most bytes of text hashed at once; a longer text makes a slice of its own.
SLICE_BYTES = 2_000_000

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_random = np.random.default_rng(20240229)
_BYTE_VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.ones(1, dtype=np.uint64)
_FACTORS = _random.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def _places(longest: int) -> np.ndarray:
    global _PLACES
    if len(_PLACES) < longest:
        more = np.full(max(longest, 2 * len(_PLACES)), _STEP, dtype=np.uint64)
        more[0] = 1
        _PLACES = np.multiply.accumulate(more)
    return _PLACES


@dataclass
class Words:
    """``hashes`` of all words in order; those of text ``i`` are ``bounds[i]:bounds[i + 1]``."""

    hashes: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """The column in runs of rows of about ``SLICE_BYTES`` of text, without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column, "")
    sizes = np.diff(_offsets(column))
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and held + size > SLICE_BYTES:
            yield column[start:row]
            start, held = row, 0
        held += size
    if start < len(column):
        yield column[start:]


def _offsets(column: pa.Array) -> np.ndarray:
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + len(column) + 1)
    return raw[column.offset :]


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a slice of texts, and where each text starts, with the end at last."""
    offsets = _offsets(column)
    data = column.buffers()[2]
    if data is None or not len(data):
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    found = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return found, offsets - offsets[0]


def word_hashes(column: pa.Array) -> Words:
    """A 64-bit hash of each word of a slice of texts."""
    data, offsets = raw_bytes(column)
    inside = ~_SPACES[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    starts[firsts] = inside[firsts]
    places = np.flatnonzero(inside)
    if not len(places):
        return Words(np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64))
    heads = np.flatnonzero(starts[places])
    lengths = np.diff(np.append(heads, len(places)))
    values = _BYTE_VALUES[data[places]]
    relative = np.arange(len(places)) - np.repeat(heads, lengths)
    values *= _places(int(lengths.max()))[relative]
    hashes = mix(np.add.reduceat(values, heads) + lengths.astype(np.uint64))
    return Words(hashes, np.searchsorted(places[heads], offsets))


def shingle_hashes(words: Words, size: int) -> Words:
    """Hashes of all runs of ``size`` words; of a shorter, non-empty text, the whole as one."""
    counts = np.diff(words.bounds)
    n = len(words.hashes)
    shingles = np.maximum(counts - size + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    if not n:
        return Words(words.hashes, bounds)
    found = np.zeros(n, dtype=np.uint64)
    for j in range(min(size, n)):
        found[: n - j] += words.hashes[j:] * _FACTORS[j]
    begin = np.repeat(words.bounds[:-1] - bounds[:-1], shingles)
    result = found[np.arange(bounds[-1]) + begin]
    for row in np.flatnonzero((counts > 0) & (counts < size)):
        own = words.hashes[words.bounds[row] : words.bounds[row + 1]]
        result[bounds[row]] = np.sum(own * _FACTORS[: len(own)]) + np.uint64(len(own))
    return Words(mix(result), bounds)


def distinct(shingles: Words) -> Words:
    """The sorted set of each text's hashes."""
    sets = [np.unique(shingles.hashes[a:b]) for a, b in zip(shingles.bounds[:-1], shingles.bounds[1:])]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])
    return Words(np.concatenate([np.zeros(0, dtype=np.uint64), *sets]), bounds.astype(np.int64))


def shingle_sets(column: pa.Array, size: int) -> Words:
    return distinct(shingle_hashes(word_hashes(column), size))
