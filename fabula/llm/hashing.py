"""64-bit hashes of the words of an Arrow batch, computed on its bytes without a Python object for any word.

A word is a run of bytes that aren't ASCII white space; A-Z count as a-z. Its hash is the sum of a random number for each
byte times a power of an odd constant for its place, read off prefix sums, and mixed. Words of more than `SPAN` bytes
are hashed by xxhash. Equal words have equal hashes in every batch and task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPAN = 1 << 15
_GAP = np.zeros(256, dtype=bool)
_GAP[list(b" \t\n\x0b\x0c\r")] = True
_RNG = np.random.default_rng(20_250_101)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_ODD = 0x9E3779B97F4A7C15
_POWER = np.multiply.accumulate(np.append(np.uint64(1), np.full(2 * SPAN, _ODD, dtype=np.uint64)))
_INVERSE = np.multiply.accumulate(np.append(np.uint64(1), np.full(2 * SPAN, pow(_ODD, -1, 1 << 64), dtype=np.uint64)))
_MIX, _SHIFT = np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _MIX
    return h ^ (h >> _SHIFT)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows behind each other, and where each row begins (one more entry for the end); a null has none."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and at[-1] > at[0] else np.empty(0, dtype=np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a string array behind each other, and where each row's words begin (one more entry for the end)."""
    data, rows = _bytes(column)
    gap = np.ones(len(data) + 1, dtype=bool)
    gap[:-1] = _GAP[data]
    breaks = gap.copy()  # where a word can't go on: at gaps and where a row begins
    breaks[rows[1:-1]] = True
    opens = ~gap
    opens[1:] &= gap[:-1] | breaks[1:]
    starts = np.flatnonzero(opens)
    breaks[0] = False
    breaks[1:] &= ~gap[:-1]
    ends = np.flatnonzero(breaks)
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, first + SPAN, side="right")))
        if ends[at] - first > SPAN:
            out[at] = xxhash.xxh3_64_intdigest(data[first : ends[at]].tobytes().lower())
        else:
            last = int(ends[to - 1])
            sums = np.zeros(last - first + 1, dtype=np.uint64)
            np.cumsum(_BYTE[data[first:last]] * _POWER[: last - first], out=sums[1:])
            a, b = starts[at:to] - first, ends[at:to] - first
            out[at:to] = (sums[b] - sums[a]) * _INVERSE[a]
        at = to
    return mixed(out), np.searchsorted(starts, rows)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of `size` words; of fewer words, the whole sequence is one; without words, none."""
    h, first = word_hashes(column)

    def runs(x: np.ndarray, n: int) -> np.ndarray:
        out = np.full(max(len(x) - n + 1, 0), n, dtype=np.uint64)
        for i in range(n):
            out = mixed(out * _MIX ^ x[i : len(x) - n + 1 + i])
        return out

    whole, sets = runs(h, size), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        sets.append(np.unique(whole[a : b - size + 1]) if b - a >= size else runs(h[a:b], b - a) if b > a else np.empty(0, dtype=np.uint64))
    return sets
