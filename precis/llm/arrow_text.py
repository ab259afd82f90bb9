"""Vectorised text helpers for Arrow batches (used inside tasks).

A batch of texts is handled as one UTF-8 byte buffer with document offsets, cut
into slices of bounded size, so memory does not grow with the batch. A null
text counts as empty everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text worked on at once; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 21
# The same where several stages share one executor: hashing takes some forty bytes a byte.
SMALL_SLICE = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
# White space of the word rule [^\x20\x09-\x0D]+.
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a string column into ``(first_row, bytes, offsets)`` of about
    ``limit`` bytes; ``offsets`` has one entry more than the slice has rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ``starts`` and ``ends`` of the words (``[^\\x20\\x09-\\x0D]+``, or runs
    between the given ``separator`` bytes) and, per document, the index of its first word (one entry more than documents)."""
    apart = separator[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    before = np.concatenate(([True], apart[:-1]))
    after = np.concatenate((apart[1:], [True]))
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = True
    after[edges - 1] = True
    starts = np.flatnonzero(~apart & before[: len(apart)])
    ends = np.flatnonzero(~apart & after[: len(apart)]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * _U(pow(base, have, 1 << 64))
        have += more
    return out


class WordHasher:
    """64-bit hashes of byte ranges through prefix sums of a polynomial."""

    def __init__(self) -> None:
        self._up = self._down = np.ones(1, dtype=np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self._up) < len(data) + 1:
            self._up, self._down = _powers(_BASE, len(data) + 1), _powers(_INVERSE, len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + _U(1)) * self._up[: len(data)], out=sums[1:])
        out = (sums[ends] - sums[starts]) * self._down[starts]
        return mix64(out + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z only."""
    return _LOWER[data]


def per_doc(values: np.ndarray, first: np.ndarray, ufunc: np.ufunc, empty) -> np.ndarray:
    """Reduce runs of ``values`` given by ``first`` (one entry more than runs)."""
    out = np.full(len(first) - 1, empty, dtype=values.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = ufunc.reduceat(values, first[full])
    return out
