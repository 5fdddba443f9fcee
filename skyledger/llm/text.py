"""Words, shingles and minima of a whole Arrow batch of texts, as numpy arrays.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``; A-Z count as a-z in its
hash. Nothing here depends on how texts are dealt to batches.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"
_BLOCK = 1 << 20
_MASK = (1 << 64) - 1


def _noise(seed: int, n: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers: the public splitmix64 sequence."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_BYTES = _noise(11, 256)
_BYTES[65:91] = _BYTES[97:123]
_BASE = np.uint64(0xD1342543DE82EF95)
_PLACES = _noise(23, 64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more entry at the end); null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each non-empty byte span; spans may overlap."""
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    longest = int(lengths.max())
    power = np.multiply.accumulate(np.full(longest, _BASE, np.uint64))
    total = np.cumsum(lengths)
    lo = 0
    while lo < len(starts):
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + _BLOCK, "right")))
        size = lengths[lo:hi]
        first = total[lo:hi] - size - done
        place = np.arange(total[hi - 1] - done) - np.repeat(first, size)
        value = _BYTES[data[place + np.repeat(starts[lo:hi], size)]] * power[place]
        out[lo:hi] = np.add.reduceat(value, first)
        lo = hi
    return mix(out)


@dataclass
class Words:
    """``hash``, ``starts``, ``ends``: one entry a word; text ``i`` owns entries ``splits[i]:splits[i + 1]``."""

    hash: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    splits: np.ndarray


def find_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end byte of every word, and each text's part of them."""
    n = len(data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    fresh = edge.copy()
    fresh[1:n] |= ~inside[: n - 1] if n else False
    starts = np.flatnonzero(inside & fresh[:n])
    over = edge[1:].copy()
    over[: n - 1] |= ~inside[1:] if n else False
    ends = np.flatnonzero(inside & over) + 1
    return starts, ends, np.searchsorted(starts, at)


def read_words(column: pa.Array) -> Words:
    data, at = utf8(column)
    starts, ends, splits = find_words(data, at)
    return Words(hash_spans(data, starts, ends), starts, ends, splits)


def shingles(words: np.ndarray, splits: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and each text's part of them.

    A text with fewer words has its whole sequence as one shingle; a text
    without words has none. Repeated shingles repeat.
    """
    count = np.diff(splits)
    here = np.arange(len(words))
    end = np.repeat(splits[1:], count)
    value = np.zeros(len(words), np.uint64)
    for k in range(min(size, len(words))):
        part = words[k:] * _PLACES[k]
        value[: len(words) - k] += np.where(here[: len(words) - k] + k < end[: len(words) - k], part, np.uint64(0))
    short = np.repeat(count < size, count)
    keep = np.where(short, here == np.repeat(splits[:-1], count), here + size <= end)
    own = np.where(count < size, np.minimum(count, 1), count - size + 1)
    return mix(value[keep]), np.concatenate([[0], np.cumsum(own)])


def permutations(n: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of ``n`` multiply-shift universal hash functions."""
    return _noise(seed, n) | np.uint64(1), _noise(seed + 1, n)


def minima(values: np.ndarray, splits: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Least 32-bit hash of each text's values under every permutation; texts without values get 2**32 - 1."""
    multiply, offset = factors
    out = np.full((len(splits) - 1, len(multiply)), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(splits))
    begin, stop = splits[:-1][full], splits[1:][full]
    lo = 0
    while lo < len(full):
        hi = max(lo + 1, int(np.searchsorted(stop, begin[lo] + (1 << 15), "right")))
        part = values[begin[lo] : stop[hi - 1]]
        first = begin[lo:hi] - begin[lo]
        work = np.empty_like(part)
        rows = full[lo:hi]
        for k in range(len(multiply)):
            np.multiply(part, multiply[k], out=work)
            work += offset[k]
            out[rows, k] = np.minimum.reduceat(work, first) >> np.uint64(32)
        lo = hi
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about ``most`` bytes of text, so that arrays stay small; no text is cut."""
    for batch in batches:
        _, at = utf8(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end, what the worker has freed goes back to the system instead of waiting for its next task."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
