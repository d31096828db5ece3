"""Vectorised text passes over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Words, shingles
and windows are known by 64-bit hashes that depend on their bytes alone, so all
executors agree on them. Work goes in slices of whole documents of about
``SLICE_BYTES``; memory is bounded by that or by the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes between terms of letters and digits: all ASCII but 0-9, A-Z and a-z.
_MARKS = np.arange(256) < 0x80
_MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_B = np.uint64(0xD6E8FEB86659FD93)
_S = [np.uint64(x) for x in (30, 27, 31)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the word."""
    x = (x ^ (x >> _S[0])) * _M2
    x = (x ^ (x >> _S[1])) * _M3
    return x ^ (x >> _S[2])


def lowered(data: np.ndarray) -> np.ndarray:
    """A copy of the bytes with A-Z as a-z."""
    return _LOWER[data]


@dataclass
class Words:
    """The words of some documents: ``starts``/``ends`` are byte places in ``data``,
    ``first[d]:first[d + 1]`` are the words of document ``d``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word: eight bytes at a time, then the length."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        chunk = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        size = (self.ends - self.starts).astype(np.int64)
        h = size.astype(np.uint64) * _M1
        live = np.arange(len(size))
        at, left = self.starts.astype(np.int64), size
        while len(live):
            x = chunk[at]
            short = left < 8
            if short.any():
                keep = (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
                x[short] &= keep
            h[live] = mix64((h[live] ^ x) * _B + _M1)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        return h

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def split_terms(column: pa.Array) -> Words:
    """Maximal runs of 0-9, A-Z, a-z and signs beyond ASCII, with A-Z as a-z; null texts have none."""
    return split_words(column, lower=True, gap=_MARKS)


def split_words(column: pa.Array, lower: bool = False, gap: np.ndarray = _SPACE) -> Words:
    """Words of each text; null texts have none. ``lower`` maps A-Z to a-z first. ``gap``: whether a byte is between words."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), np.int64))
    ink = ~gap[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = ink[1:] != ink[:-1]
    edge[offsets] = True
    places = np.flatnonzero(edge)
    full = ink[places[:-1]]
    starts, ends = places[:-1][full], places[1:][full]
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def decoded(column: pa.Array) -> Iterator[str | None]:
    """The texts, one by one; bytes that are no UTF-8 count as U+FFFD."""
    for x in column.cast(pa.binary()):
        yield None if (raw := x.as_py()) is None else raw.decode("utf-8", "replace")


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text each, one document at least."""
    size = np.asarray(pc.binary_length(column).fill_null(0), np.int64)
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
        yield at, to
        at = to


def runs_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` items from each place on; shorter by ``k - 1`` than the input.
    Doubling: the hash of 2m items comes from two of m items."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, power, block, size = np.zeros(n, np.uint64), 0, int(_B), hashes, 1
    left = k
    while left:
        if left & 1:
            out = out * np.uint64(power) + block[have : have + n]
            have += size
        left >>= 1
        if left:
            block = block[: len(block) - size] * np.uint64(power) + block[size:]
            power = power * power & 0xFFFFFFFFFFFFFFFF
            size *= 2
    return mix64(out)


def valid_runs(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which ``k`` words of one document start, and the runs each document has."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    return ranges(first[:-1], counts), counts


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` of ``counts[i]`` numbers each, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Least of each ``k`` neighbours, by doubling."""
    size = 1
    while size * 2 <= k:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = k - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.astype(np.uint64).view(np.int64)
