"""Vectorised views of a column of texts.

An Arrow string column is one byte buffer with offsets.  The helpers find words,
lines and their hashes for many documents at once, without a Python object per
word.  A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The six ASCII white-space characters that end a word.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Odd and 3 modulo 8, so that powers of it do not repeat early.
BASE = 0x9E3779B97F4A7C13 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def portions(off: np.ndarray, limit: int = 1 << 20, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes and ``rows`` rows, or of one longer row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1))
        yield i, j
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        inverse = pow(BASE, -1, 1 << 64)
        for key, base in (("up", BASE), ("down", inverse)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[key] = np.cumprod(table)
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """n + 1 sums of (byte + 1) * BASE^position, modulo 2^64."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    terms = buf.astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[:len(buf)]
    np.cumsum(terms, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; it depends on the bytes and the length alone."""
    _, down = powers(len(prefix))
    raw = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` that stay within a row."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    filled = off[:-1] < off[1:]
    first, last = off[:-1][filled], off[1:][filled] - 1
    start[first] = inside[first]
    end[last] = inside[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def rows_of(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The row that each start lies in."""
    return np.searchsorted(off, starts, side="right") - 1


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words ``[^\\x20\\x09-\\x0D]+``."""
    starts, ends = spans(~SPACE[buf], off)
    return starts, ends, rows_of(starts, off)


def lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the ``\\n``-split lines that hold a byte."""
    starts, ends = spans(buf != 10, off)
    return starts, ends, rows_of(starts, off)


def counts(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of the flags of each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: how often it occurs, and whether it is its first occurrence."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    group = np.cumsum(new) - 1
    number = np.empty(len(keys), np.int64)
    number[order] = np.bincount(group)[group]
    first = np.empty(len(keys), bool)
    first[order] = new
    return number, first
