"""Words of a whole Arrow column of texts as NumPy arrays: no Python object per word.

Texts are handled in slices of some two megabytes, so memory depends on the longest single text,
never on the batch. A word's hash scrambles its bytes in eights, each with its place in the word. Runs
of words have polynomials over word hashes modulo 2^64, taken from prefix sums and scrambled at the end;
these serve to choose and to filter. Where equal hashes decide a result, bytes or digests are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000
_BYTES = np.arange(256)
SPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))  # [^\x20\x09-\x0D]+
PLAIN = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)  # after A-Z are lowered
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
SAME = _BYTES.astype(np.uint8)

WORD_BASE = 0xD1342543DE82EF95
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the low n bytes


def mix(x: np.ndarray) -> np.ndarray:
    """Final scrambling of 64-bit values (the SplitMix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64))]).astype(np.uint64) for b in (self.base, self.inverse))

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for each span."""
        self.upto(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts])


class Texts(NamedTuple):
    """Some consecutive rows of a batch. Word arrays run over all of them; ``first[i]:first[i+1]`` are those of row i."""

    row: int  # of the first text, in the batch
    data: np.ndarray  # bytes, lowered where asked
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def words(self, at: int, to: int) -> bytes:
        """Words at:to joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[at:to], self.ends[at:to]))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64 bits of each word. Eight bytes at a time pass through a scrambler keyed by their place and the seed."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        size = self.ends - self.starts
        eights = (size + 7) // 8
        first = np.cumsum(eights) - eights
        place = np.arange(int(eights.sum())) - np.repeat(first, eights)
        at = np.repeat(self.starts, eights) + 8 * place
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        any_eight = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        chunk = any_eight[at] & _KEEP[np.minimum(np.repeat(self.ends, eights) - at, 8)]
        mixed = mix(mix(chunk + np.uint64(0x9E3779B97F4A7C15)) ^ mix(place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed + 1)))
        return mix(np.add.reduceat(mixed, first) + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def grams(self, hashes: np.ndarray, k: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of all runs of k words inside one text."""
        counts = np.maximum(np.diff(self.first) - k + 1, 0)
        at = ramp(self.first[:-1], counts)
        return at, powers.spans(hashes, at, at + k)


def ramp(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each range, one after the other."""
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(starts - before, counts)


def slices(column: pa.Array, kind: np.ndarray, lower: bool) -> Iterator[Texts]:
    """The texts of an Arrow string column (null: empty), split into words of the byte class ``kind``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        at = offsets[row : to + 1] - offsets[row]
        part = (LOWER if lower else SAME)[whole[offsets[row] : offsets[to]]]
        inside = kind[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[at] = True
        starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
        ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        yield Texts(row, part, starts, ends, np.searchsorted(starts, at))
        row = to


def window_minima(hashes: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Winnowing: for each window of ``width`` consecutive entries of one group, the index of its
    rightmost least entry. ``group`` holds the bounds of the groups."""
    counts = np.maximum(np.diff(group) - width + 1, 0)
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    best, at, done = hashes.copy(), np.arange(len(hashes)), 1
    while done < width:  # least of a run of 2*done from two runs of done, up to width
        step = min(done, width - done)
        left, right = best[: len(best) - step], best[step:]
        take = right <= left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[: len(at) - step])
        done += step
    return at[ramp(group[:-1], counts)]
