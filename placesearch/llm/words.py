"""Words of Arrow text columns as numpy arrays of 64-bit hashes.

Words are runs without space, tab, line feed, vertical tab, form feed and carriage return, with
A-Z lower-cased.  All work is on byte arrays, in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20               # bytes hashed at once
CHUNK = 4 << 20               # bytes of whole texts taken together
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 5)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256).astype(_U)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < size + 1:
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size + 1, base, dtype=_U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of runs of whole texts; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = (np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size
            else np.zeros(0, dtype=np.uint8))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the place of each text's first word among them."""
    inside = ~_BLANK[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = inside[first]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[last] = inside[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's lower-cased bytes."""
    found = np.empty(len(starts), dtype=_U)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, side="right")))
        low, high = starts[at], ends[stop - 1]
        up, down = _power_tables(max(PIECE, int(high - low)))
        total = np.zeros(high - low + 1, dtype=_U)
        np.cumsum(_VALUE[_LOWER[data[low:high]]] * up[:high - low], out=total[1:])
        s, e = starts[at:stop] - low, ends[at:stop] - low
        found[at:stop] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U))
        at = stop
    return found


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, hashes of all words, place of each text's first word)`` per run of texts."""
    for row, data, offsets in chunks(column):
        starts, ends, first = spans(data, offsets)
        yield row, hashes(data, starts, ends), first


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words of one text; all its words as one if it has fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    count = len(words) - size + 1
    found = np.full(count, size, dtype=_U)
    for j in range(size):
        found = mix(found * _BASE + words[j:j + count])
    return found
