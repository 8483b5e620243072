"""Vectorised views of Arrow string columns for the operators' Python workers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes 0x20 and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the rows' offsets in them (null: no bytes)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    every = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = 1 << 19):
    """Row ranges (lo, hi) of about `most` bytes of text each; a longer row stands alone."""
    if len(column) == 0:
        return
    _, offsets = flat(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, min(hi, len(column))
        lo = min(hi, len(column))


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit keys (multiply-xorshift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _byte_keys() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTE_KEYS = _byte_keys()
#: Powers of an odd base; position weights within a word.
POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """Words between ASCII blanks of every row.

    Returns (hash of each word, its byte length, its start, number of words of each row).
    A word's hash depends on its bytes only (A-Z lowered if `lower`).
    """
    rows = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(rows, np.int64)
    if lower:
        data = LOWER[data]
    solid = ~IS_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    cut = offsets[:-1][np.diff(offsets) > 0]
    begins[cut] = solid[cut]
    start = np.flatnonzero(begins)
    if not len(start):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(rows, np.int64)
    at = np.flatnonzero(solid)
    bounds = np.searchsorted(at, start)
    length = np.diff(np.append(bounds, len(at)))
    within = np.arange(len(at)) - np.repeat(bounds, length)
    value = BYTE_KEYS[data[at]] * POWERS[within & 4095] ^ (within >> 12).astype(np.uint64)
    hashed = mix(np.add.reduceat(value, bounds) + length.astype(np.uint64))
    per_row = np.diff(np.searchsorted(start, offsets))
    return hashed, length, start, per_row
