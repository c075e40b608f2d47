"""Vectorised primitives over the raw UTF-8 bytes of an Arrow text column.

Every function works on chunks of about a megabyte, so memory stays flat however many rows a partition holds; a single
longer text makes one longer chunk. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 20

# The odd multiplier is invertible modulo 2^64, so a prefix sum gives the hash of any span.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)

#: The word separators of the contracts: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII capitals to small letters, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a string column into (first row, bytes, row offsets within them) of about ``limit`` bytes each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, raw[offs[i] : offs[j]], (offs[i : j + 1] - offs[i])
        i = j


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, n + 1 of each at least; the longest tables so far are kept."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        tables = np.full(size + 1, _BASE, U), np.full(size + 1, _INVERSE, U)
        for t in tables:
            t[0] = 1
            np.multiply.accumulate(t, out=t)
        _POWERS[:] = tables
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every output bit depends on every input bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Running sums of per-byte values times the powers; see :func:`span_hash`."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end): equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(sums) - 1)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


def runs(solid: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that stay within a row: start, end, row."""
    n = len(solid)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    end[:-1] &= ~solid[1:] | edge[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(offs, s, "right") - 1


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(~SPACE[buf], offs)


def counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def ngrams(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-grams that stay within a row, and the index of each one's first item."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.zeros(n, U)
    for i in range(k):
        h = h * U(0x2545F4914F6CDD1D) + hashes[i : i + n]
    first = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return mix(h[first]), first


def lean(run):
    """``run``, a function from Arrow batches to Arrow batches, that gives its worker's free memory back when it ends.

    Spark keeps Python workers for later tasks, of any operator; without this each keeps the most it ever held.
    """

    @wraps(run)
    def through(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return through


def lean_group(run):
    """As :func:`lean`, for a function of one group."""

    @wraps(run)
    def through(group):
        try:
            return run(group)
        finally:
            give_back()

    return through


def give_back() -> None:
    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library has no such call
        pass
