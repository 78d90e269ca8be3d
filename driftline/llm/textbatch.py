"""Vectorised text primitives over Arrow string columns.

A batch is one byte buffer plus row offsets.  Words, shingles and their XXH64
values are computed for all rows of a batch with numpy, so no Python code runs
per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Rows are processed in runs of about this many bytes, which bounds temporaries.
RUN_BYTES = 2 << 20
#: Byte ranges beyond this length are hashed one by one.
_LONG = 160

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(buf: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of :func:`utf8`."""
    n = len(offsets) - 1
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buf.tobytes()))


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about ``limit`` bytes each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z as a-z; every other byte as it is."""
    return _LOWER[buf]


@dataclass
class Words:
    """Words of all rows, joined by one space each.

    ``buf`` holds every word followed by a space, ``starts``/``ends`` are the
    words' byte ranges in it and row ``i`` has words ``first[i]:first[i + 1]``.
    """

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split_words(buf: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray | None = None) -> Words:
    """Maximal runs of word bytes in each row; by default bytes that aren't white space."""
    inside = word_byte[buf] if word_byte is not None else ~_SPACE[buf]
    n = len(buf)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True  # a row starts or ends here
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    lens = ends - starts
    first = np.searchsorted(starts, offsets)
    at = np.cumsum(lens + 1) - (lens + 1)
    packed = np.full(int((lens + 1).sum()), 32, dtype=np.uint8)
    total = int(lens.sum())
    packed[np.arange(total) + np.repeat(np.arange(len(lens)), lens)] = buf[inside]
    return Words(packed, at, at + lens, first)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and lengths of all ``size``-word shingles, and row boundaries.

    A row with fewer words, but not none, has its whole sequence as one shingle.
    """
    m = words.counts
    total = int(words.first[-1] - words.first[0])
    idx = np.arange(total) + words.first[0]
    stop = np.repeat(words.first[1:], m)
    begin = np.repeat(words.first[:-1], m)
    keep = (idx + size <= stop) | (idx == begin)
    idx, stop = idx[keep], stop[keep]
    last = np.minimum(idx + size, stop) - 1
    per_row = np.where(m >= size, m - size + 1, np.minimum(m, 1))
    bounds = np.concatenate([[0], np.cumsum(per_row)])
    return words.starts[idx], words.ends[last] - words.starts[idx], bounds


_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)  # XXH64's published primes


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges of one buffer.

    Ranges of one length are hashed together; rare long ones go to the library.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    lanes = np.ascontiguousarray(np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,)))
    small = np.minimum(lens, _LONG + 1).astype(np.uint8)  # a radix sort serves bytes
    order = np.argsort(small, kind="stable")
    cuts = np.flatnonzero(np.diff(small[order])) + 1
    raw = buf.tobytes() if small[order[-1]] > _LONG else b""
    with np.errstate(over="ignore"):
        for group in np.split(order, cuts):
            size = int(lens[group[0]])
            if size > _LONG:
                for i in group.tolist():
                    s = int(starts[i])
                    out[i] = xxhash.xxh64_intdigest(raw[s : s + size], seed)
            else:
                out[group] = _same_length(padded, lanes, starts[group], size, seed)
    return out


def _same_length(buf: np.ndarray, lanes: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    seed64 = np.uint64(seed)
    left = size
    if size >= 32:
        acc = [
            np.full(len(at), v, np.uint64)
            for v in (seed64 + _P1 + _P2, seed64 + _P2, seed64, seed64 - _P1)
        ]
        while left >= 32:
            acc = [_round(a, lanes[at + 8 * i]) for i, a in enumerate(acc)]
            at, left = at + 32, left - 32
        h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            h = (h ^ _round(np.uint64(0), a)) * _P1 + _P4
    else:
        h = np.full(len(at), seed64 + _P5, np.uint64)
    h = h + np.uint64(size)
    while left >= 8:
        h = _rotl(h ^ _round(np.uint64(0), lanes[at]), 27) * _P1 + _P4
        at, left = at + 8, left - 8
    if left >= 4:
        h = _rotl(h ^ (lanes[at] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
        at, left = at + 4, left - 4
    for _ in range(left):
        h = _rotl(h ^ buf[at].astype(np.uint64) * _P5, 11) * _P1
        at = at + 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))
