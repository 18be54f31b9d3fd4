"""Vectorised byte-level text work shared by the operators: words, hashes, blobs.

Arrow hands over whole columns; the functions here read their buffers without
copying and work on slices of about one megabyte of text, so that memory follows
the longest text and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text bytes worked on at a time; a longer single text is taken whole.
SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


#: What gives up the things that operators keep in a worker from task to task.
KEPT: list[Callable[[], None]] = []


def give_back() -> None:
    """Hand freed memory of Arrow's and C's allocators back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def give_up() -> None:
    """Call all of ``KEPT``."""
    for f in KEPT:
        f()


def thrifty(run: Callable, keeps: bool = False) -> Callable:
    """``run`` over Arrow batches, which hands freed memory back behind each batch.

    Workers are reused: what one stage leaves in their allocators, or keeps for its
    next task, would stand beside all later stages of the executor. So whatever doesn't
    itself keep things gives up those of other stages first.
    """

    def frugal(batches):
        def given():
            for t in batches:
                yield t
                del t
                give_back()

        if not keeps:
            give_up()
        try:
            yield from run(given())
        finally:
            give_back()

    return frugal


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POW.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            _POW[name] = np.multiply.accumulate(p)
    return _POW["up"][:n], _POW["down"][:n]


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        empty = pa.scalar(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "", column.type)
        column = column.fill_null(empty)
    _, off, data = column.buffers()
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, raw


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts with about ``limit`` bytes together; a longer text stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def words(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts ``buf[cuts[i]:cuts[i+1]]``.

    Returns starts, ends and, for each text, the number of its first word
    (``len(cuts)`` numbers, the last being the number of words).
    """
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(cuts), np.int64)
    solid = ~SPACE[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = cuts[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(s, cuts, "left")


def span_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [s, e), equal for equal bytes wherever they stand."""
    up, down = _powers(len(buf) + 1)
    h = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE_CODE[buf] * up[: len(buf)], out=h[1:])
    return mix((h[e] - h[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_hashes(column, fold: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of a text column: (a, b, hashes of the words, first word of each text a..b)."""
    offsets, raw = texts(column)
    for a, b in slices(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        buf = LOWER[raw[lo:hi]] if fold else raw[lo:hi]
        s, e, firsts = words(buf, offsets[a : b + 1] - lo)
        yield a, b, span_hashes(buf, s, e), firsts


def sort_by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that groups small bucket numbers, and the n + 1 bounds of the groups."""
    order = np.argsort(bucket, kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=n))))
