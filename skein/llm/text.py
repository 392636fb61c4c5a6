"""Vectorised work on the bytes of Arrow string columns.

No Python string is made per word: a record batch is cut into blocks of about
``BLOCK`` bytes (a longer text is a block of its own), word bounds come from a
lookup table, hashes of words and of word windows from mixed tables and trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_SEEDS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_LEFT, _RIGHT = np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5)
_NEAR, _PART = 64, 1 << 16

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _placed(values: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit value for each (value, place), without any relation between places."""
    return mix(values.astype(np.uint64) ^ mix((place.astype(np.uint64) + np.uint64(1)) * _SEEDS[seed]))


@lru_cache
def _table(seed: int) -> np.ndarray:
    """_placed of every byte at the first _NEAR places."""
    return _placed(np.tile(np.arange(256), _NEAR), np.repeat(np.arange(_NEAR), 256), seed)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of values[start:end] for ascending runs that don't overlap, by tabulation: each place has a table of its own.

    Sums of products with powers would collide for repetitive words, whatever the base.
    """
    out = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):  # in parts that stay in the cache
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _PART, "right")))
        low, high = starts[a], ends[b - 1]
        heads = (starts[a:b] - low).astype(np.int32)
        place = np.arange(high - low, dtype=np.int32)
        place -= np.repeat(heads, np.diff(heads, append=np.int32(high - low)))  # what follows a run counts on, and is left out below
        part = values[low:high]
        if part.dtype == np.uint8:
            index = np.minimum(place, _NEAR - 1)
            index <<= 8
            index |= part
            each = _table(seed).take(index)
            far = np.flatnonzero(place >= _NEAR)
            if len(far):
                each[far] = _placed(part[far], place[far], seed)
        else:
            each = _placed(part, place, seed)
        each = np.append(each, np.uint64(0))
        bounds = np.stack([heads, ends[a:b] - low], 1).ravel()
        out[a:b] = np.where(bounds[::2] < bounds[1::2], np.add.reduceat(each, bounds)[::2], np.uint64(0))
        a = b
    return mix(out + (ends - starts).astype(np.uint64) * _LEFT)


def window_hashes(values: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash of values[i:i+width] for every full window, as a tree of mixed pairs built by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    have, size, done = mix(values.astype(np.uint64) ^ _SEEDS[seed]), 1, 0
    out = np.full(n, width, np.uint64)
    while True:
        if width & size:
            out = mix(out * _LEFT + have[done : done + n] * _RIGHT)
            done += size
        if 2 * size > width:
            return out
        have = mix(have[:-size] * _LEFT + have[size:] * _RIGHT)
        size *= 2


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offs


def blocks(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of blocks of whole texts."""
    data, offs = column_bytes(column)
    row, rows = 0, len(offs) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offs, offs[row] + BLOCK, "right")) - 1)
        yield row, to, data[offs[row] : offs[to]], offs[row : to + 1] - offs[row]
        row = to


def word_bounds(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and each text's first word; no word spans two texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~space[data]
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(word[1:], word[:-1], out=edge[1:])
    cuts = offs[(offs > 0) & (offs < n)]
    edge[cuts] = True
    starts = np.flatnonzero(edge & word)
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = edge[1:]
    ends = np.flatnonzero(last & word) + 1
    return starts, ends, np.searchsorted(starts, offs)


def row_of(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sliding(values: np.ndarray, width: int, op=np.minimum) -> np.ndarray:
    """op over values[i:i+width] for every full window, by doubling."""
    if len(values) < width:
        return values[:0]
    have, size = values, 1
    while 2 * size <= width:
        have = op(have[:-size], have[size:])
        size *= 2
    rest = width - size
    return op(have[: len(have) - rest], have[rest:]) if rest else have
