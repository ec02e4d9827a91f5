"""Vectorised words and hashes over Arrow string columns.

Everything works on the UTF-8 bytes of a whole slice of rows at once; no Python object is made per word. Slices hold at
most ``SLICE_BYTES`` of text or one longer row, so memory does not follow the number of rows, and the length of a text
by a few bytes per byte of it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 19
#: Runs hashed at a time, and the bytes beyond which a run is hashed by itself.
RUNS, LONG_WORD = 1 << 17, 256

U64 = np.uint64


def release_memory() -> None:
    """Give freed memory back to the system: a worker that stays alive shares its executor's limit with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit over all others."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def classes(words: str) -> np.ndarray:
    """Table of 256: which bytes belong to words. Bytes of multi-byte characters always do."""
    ok = np.zeros(256, bool)
    ok[128:] = True
    if words == "blank":  # [^\x20\x09-\x0D]+
        ok[:128] = True
        ok[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    elif words == "alnum":  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
        ok[0x30:0x3A] = ok[0x61:0x7B] = ok[0x41:0x5B] = True
    else:
        raise ValueError(words)
    return ok


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Masks of the first 0 to 8 bytes of a number.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


@dataclass
class Slice:
    """Rows lo to hi of a batch. starts and ends: of each row's bytes in data."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Consecutive rows of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1)
        a, b = off[lo], off[hi]
        yield Slice(lo, hi, raw[a:b], off[lo:hi] - a, off[lo + 1 : hi + 1] - a)
        lo = hi


def segments(inside: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at the rows' starts."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        change = np.concatenate(([0], change))
    if inside[-1]:
        change = np.concatenate((change, [n]))
    starts, ends = change[::2], change[1::2]
    cut = row_starts[(row_starts > 0) & (row_starts < n)]
    cut = np.unique(cut[inside[cut] & inside[cut - 1]])
    if len(cut):
        starts = np.insert(starts, np.searchsorted(starts, cut), cut)
        ends = np.insert(ends, np.searchsorted(ends, cut), cut)
    return starts, ends


def _lanes(padded: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number, bytes beyond the run's end as zeros."""
    loose = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    return loose[at] & _KEEP[np.minimum(left, 8)]


def hash_segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte runs, eight bytes a step through a full mixer.

    Runs of up to eight bytes never share a hash with another of their length; longer ones do as seldom as random
    numbers, as no step is linear. Runs beyond LONG_WORD bytes, which are few, are hashed one by one.
    """
    length = (ends - starts).astype(np.int64)
    out = mix64(length.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0x2545F4914F6CDD1D))
    for a in range(0, len(starts), RUNS):
        _hash_runs(data, starts[a : a + RUNS], length[a : a + RUNS], out[a : a + RUNS], lower)
    return out


def _hash_runs(data: np.ndarray, starts: np.ndarray, length: np.ndarray, out: np.ndarray, lower: bool) -> None:
    """Hashes of neighbouring runs into out, which holds the mixed lengths."""
    if not len(starts):
        return
    base = int(starts[0])
    part = data[base : int(starts[-1] + length[-1])]
    padded = np.concatenate((LOWER[part] if lower else part, np.zeros(8, np.uint8)))
    at, left, todo = starts - base, length, np.arange(len(starts))
    for i in np.flatnonzero(length > LONG_WORD):
        out[i] ^= U64(xxhash.xxh3_64_intdigest(padded[at[i] : at[i] + length[i]].tobytes()))
    short = length <= LONG_WORD
    if not short.all():
        at, left, todo = at[short], left[short], todo[short]
    while len(todo):
        out[todo] = mix64(out[todo] ^ _lanes(padded, at, left))
        more = left > 8
        at, left, todo = at[more] + 8, left[more] - 8, todo[more]


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray  # of each row's first word; one more at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def words_of(part: Slice, inside: np.ndarray) -> Words:
    """inside: table of classes()."""
    starts, ends = segments(inside[part.data], part.starts)
    return Words(starts, ends, np.concatenate((np.searchsorted(starts, part.starts), [len(starts)])).astype(np.int64))


_STEP = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def windows(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of width words that lies within a row; in order of position.

    Returns hashes, and the positions of the first words.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    factors = [_STEP[i % 5] * U64(2 * (i // 5) + 1) for i in range(width)]
    x = hashes[:n] * factors[0]
    for i in range(1, width):
        x += hashes[i : i + n] * factors[i]
    good = np.ones(len(hashes), bool)
    for back in range(1, width):  # the last words of each row start no window
        at = offsets[1:] - back
        good[at[at >= offsets[:-1]]] = False
    at = np.flatnonzero(good[:n])
    return mix64(x[at]), at


def row_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums over [start, end) per row."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:], dtype=np.int64)
    return sums[ends] - sums[starts]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which of them occurred earlier. A count by low bits spares most the sort."""
    twice, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) < 2:
        return twice, again
    bits = max(12, int(len(keys)).bit_length() + 2)
    low = (keys & U64((1 << bits) - 1)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(low, minlength=1 << bits)[low] > 1)
    if not len(maybe):
        return twice, again
    order = np.argsort(keys[maybe], kind="stable")
    sorted_keys = keys[maybe][order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    flag = np.zeros(len(maybe), bool)
    flag[1:] = same
    again[maybe[order]] = flag
    flag[:-1] |= same
    twice[maybe[order]] = flag
    return twice, again
