"""Words of many texts at once as 64-bit hashes, in numpy over the texts' joined bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text taken at a time; a longer text is taken alone.
CHUNK = 1 << 20
_RNG = np.random.default_rng(7)
#: A random 64-bit value for each byte, capitals valued as small letters.
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BYTE[65:91] = BYTE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer; seeds give independent functions."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of slices of a binary array; null counts as empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the end): byte bounds of the words; a word ends where its row does."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[data]
    begins, ends = solid.copy(), solid.copy()
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins[1:] &= ~solid[:-1] | cut[1:-1]
    ends[:-1] &= ~solid[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word: a polynomial in its bytes' values, from one running sum over all bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power = np.full(len(data) + 1, BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    inverse = np.full(len(data) + 1, INVERSE, np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * power[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
