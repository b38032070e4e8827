"""Vectorised text primitives shared by the operators of this subpackage.

Texts are taken as UTF-8 bytes straight from Arrow buffers.  Words are the
maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased;
each gets a 64-bit hash from one pass of a polynomial prefix sum, so no Python
object is made per word.  All memory is bounded by ``CHUNK_BYTES`` (or by one
text, where a single text is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 500_000

_U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation.
PUNCTUATION = _IS_SPACE.copy()
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche of 64-bit integers."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))[_LOWER]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES) + 1
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                p = np.full(size, base, _U)
                p[0] = 1
                _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32) if len(column) else np.zeros(1, np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of pieces of at most ``limit`` bytes, one row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte, words before each row) of every word of a chunk, in order; ``between`` marks the bytes that part words."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(_U), none, none, np.zeros(len(offsets), np.int64)
    inside = ~between[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:]
    edge = edge[(edge > 0) & (edge <= n)] - 1
    last[edge] |= inside[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, _U)
        np.cumsum(_BYTE_VALUE[data] * up[:n], out=total[1:])
        h = mix64((total[end] - total[start]) * down[start] + (end - start).astype(_U))
    return h, start, end, np.searchsorted(start, offsets)


def shingles(h: np.ndarray, before: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the runs of ``size`` words of each row; shorter rows give their whole sequence as one."""
    with np.errstate(over="ignore"):
        whole = h * _U(0x2545F4914F6CDD1D)
        if len(h) >= size:
            whole = h[: len(h) - size + 1].copy()
            for k in range(1, size):
                whole = mix64(whole * _U(0x2545F4914F6CDD1D) + h[k : len(h) - size + 1 + k])
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(whole[a : b - size + 1])
            elif b > a:
                x = h[a : a + 1].copy()
                for k in range(a + 1, b):
                    x = mix64(x * _U(0x2545F4914F6CDD1D) + h[k : k + 1])
                yield mix64(x + _U(b - a))
            else:
                yield h[:0]
