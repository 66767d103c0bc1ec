"""Vectorised byte and word kernels shared by the text operators.

Everything works on the raw UTF-8 buffers of an Arrow string column, so no Python string is made
per word. Hashes are 64-bit: two different words, shingles or windows collide with probability of
about 2**-64 a pair. Positions are bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240611))
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_TABLE_LOWER = _TABLE.copy()
_TABLE_LOWER[ord("A") : ord("Z") + 1] = _TABLE[ord("a") : ord("z") + 1]
#: A-Z become a-z, other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: All bytes but ASCII letters and the bytes of other characters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False

#: Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of text that one vectorised step holds (a longer document makes a step of its own).
STEP_BYTES = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values; spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept per process."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def release() -> None:
    """Gives memory that this process no longer uses back to the machine: workers outlive tasks and share an executor's bound."""
    import ctypes
    import gc

    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function over batches, that releases its memory when a task ends."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def steps(column: pa.Array | pa.ChunkedArray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row count, bytes, offsets of rows + end) of runs of rows; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, to - at, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values * BASE**i, with a leading 0: prefix()[j] - prefix()[i] stands for values[i:j]."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def byte_prefix(data: np.ndarray, lower: bool = False) -> np.ndarray:
    return prefix((_TABLE_LOWER if lower else _TABLE)[data])


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], equal for equal contents wherever they stand."""
    inverse = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grams(sums: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all values[i:i+q]."""
    n = len(sums) - q
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[q:] - sums[:-q]) * powers(len(sums))[1][:n])


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each row: hashes, starts, ends, and the index of each row's first word (+ end)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    gap = np.ones(n + 2, bool)
    gap[1:-1] = space[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word = ~gap[1:-1]
    start = np.flatnonzero(word & (gap[:-2] | edge[:-1]))
    end = np.flatnonzero(word & (gap[2:] | edge[1:])) + 1
    h = spans(byte_prefix(data, lower), start, end)
    return h, start, end, np.searchsorted(start, offsets)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """min(a[i:i+w]) for every i with a full window, in two passes over blocks of w."""
    n = len(a)
    if n < w:
        return a[:0]
    if w == 1:
        return a
    full = np.full(-(-n // w) * w, np.iinfo(a.dtype).max, a.dtype)
    full[:n] = a
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(gram: np.ndarray, first: np.ndarray, count: np.ndarray, window: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser anchors of all windows of ``window`` values.

    gram: hashes of the q-grams of the concatenated rows; first, count: each row's first value and
    number of values. A window's anchor is its q-gram of least hash, the leftmost of equal ones, so
    equal windows have the same anchor at the same offset. Returns, for each maximal run of windows of
    a row that share an anchor: row, anchor position, first window start, number of starts.
    """
    none = np.zeros(0, np.int64)
    span = window - q + 1
    if len(gram) < span:
        return none, none, none, none
    bits = max(1, int(len(gram) - 1).bit_length())
    low = np.uint64((1 << bits) - 1)
    best = (sliding_min((gram & ~low) | np.arange(len(gram), dtype=np.uint64), span) & low).astype(np.int64)
    starts = np.maximum(count - window + 1, 0)
    rows = np.repeat(np.arange(len(first)), starts)
    if len(rows) == 0:
        return none, none, none, none
    at = np.arange(len(rows)) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(first, starts)
    best = best[at]
    new = np.ones(len(at), bool)
    new[1:] = (best[1:] != best[:-1]) | (rows[1:] != rows[:-1])
    k = np.flatnonzero(new)
    return rows[k], best[k], at[k], np.diff(np.append(k, len(at)))


def signed(h: np.ndarray) -> np.ndarray:
    """As Spark longs."""
    return h.view(np.int64)


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of first[i] .. first[i] + count[i] - 1."""
    total = int(count.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
