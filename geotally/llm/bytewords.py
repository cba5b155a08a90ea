"""Words and their hashes in a column of texts, all at once on the column's own bytes.

The white space of the text contracts is six ASCII bytes, which are no part of a longer UTF-8
character, so words can be found on bytes.  Columns are worked on in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public SplitMix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a slice: their bytes' places, and for each text where its words begin."""

    data: np.ndarray
    first: int  # number of the slice's first text in the column
    offsets: np.ndarray  # byte offsets of the texts
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i] .. bounds[i + 1]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        lanes = np.ndarray((len(padded) - 7,), "<u8", padded.data, 0, (1,))
        size = self.ends - self.starts
        found = mix(size.astype(np.uint64) * _A + _C)
        at, lane = np.arange(len(size)), 0
        while len(at):
            left = np.minimum(size[at] - 8 * lane, 8)
            keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - left).astype(np.uint64) * np.uint64(8))
            found[at] = mix(found[at] * _A + (lanes[self.starts[at] + 8 * lane] & keep))
            lane += 1
            at = at[size[at] > 8 * lane]
        return found

    def owners(self) -> np.ndarray:
        """The text (number in the slice) that each word is of."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings, nulls as empty texts."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = column.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]] if whole is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of a column's texts, in slices of about ``size`` bytes and whole texts."""
    if not len(column):
        return
    data, offsets = texts(column)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        part = data[offsets[first] : offsets[last]]
        own = offsets[first : last + 1] - offsets[first]
        inside = ~IS_SPACE[part]
        begins = np.zeros(len(part) + 1, bool)
        begins[own] = True  # texts begin and end words
        before = np.concatenate([[False], inside[:-1]]) if len(part) else inside
        after = np.concatenate([inside[1:], [False]]) if len(part) else inside
        starts = np.flatnonzero(inside & (~before | begins[:-1]))
        ends = np.flatnonzero(inside & (~after | begins[1:])) + 1
        yield Words(part, first, own, starts, ends, np.searchsorted(starts, own))
        first = last
