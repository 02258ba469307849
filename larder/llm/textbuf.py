"""Texts of an Arrow batch as one byte array: words, and hashes of any byte or word span, without a loop per row.

A span's hash is a difference of prefix sums over powers of an odd number, modulo 2^64, so every span costs the same
however long it is. Two independent hashes make 128 bits where equality is decided by them.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

# Batches come and go: their memory goes back to the system instead of into a pool that each worker keeps.
pa.set_memory_pool(pa.system_memory_pool())

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@cache
def byte_codes(base: int) -> np.ndarray:
    """A pseudorandom 64-bit number for each byte value."""
    return np.random.default_rng(base % (1 << 32)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base and of its inverse, modulo 2^64."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n + 1, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers[base] = (both[0], both[1])
    return _powers[base]


def give_back() -> None:
    """At the end of a task: freed memory goes back to the system, as the worker process lives on for other tasks."""
    with contextlib.suppress(OSError, AttributeError):  # other systems do so by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that makes every bit depend on every other one."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Spans:
    """Hashes of spans of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray, base: int):
        n = len(codes)
        power, self.inverse = powers(base, n)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes * power[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(x + (end - start).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        """Hash of each span of ``length`` codes, by its start."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.empty(0, dtype=np.uint64)


def byte_spans(data: np.ndarray, base: int = BASES[0]) -> Spans:
    return Spans(byte_codes(base)[data], base)


class Chunk:
    """Some rows' texts, one after another. ``bounds`` has one entry more than there are rows; null texts are empty."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds = first, data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, k: int) -> bytes:
        return self.data[self.bounds[k] : self.bounds[k + 1]].tobytes()

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and each row's first word (with one entry more than there are rows)."""
        solid = ~SPACES[self.data]
        n = len(solid)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(self.bounds), np.int64)
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.bounds] = True
        opens, closes = solid.copy(), solid.copy()
        opens[1:] &= ~solid[:-1] | cut[1:n]
        closes[:-1] &= ~solid[1:] | cut[1:n]
        starts = np.flatnonzero(opens)
        return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, self.bounds)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of an Arrow column in pieces of whole rows, each near ``limit`` bytes or one longer row."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        a, b = bounds[first], bounds[last]
        yield Chunk(first, data[a:b], bounds[first : last + 1] - a)
        first = last


def window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by the start of the window: prefix and suffix minima of blocks of that width."""
    n = len(keys)
    if n < width:
        return np.empty(0, dtype=keys.dtype)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(keys.dtype).max, dtype=keys.dtype)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])
