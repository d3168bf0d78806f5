"""Small numpy helpers for text that Spark hands over as Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
#: One random 64-bit value for each byte; the seed is part of every stored hash's meaning.
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


#: Each drops something that a worker keeps between tasks.
KEPT: list[Callable[[], None]] = []


def let_go() -> None:
    """Drops what tasks of other operators kept in this Python worker, and gives its free memory back to the system."""
    for drop in KEPT:
        drop()
    trim()


def trim() -> None:
    """Gives this Python worker's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first n powers and those of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any ranges of a sequence of 64-bit values, from one pass of prefix sums."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        """Of every range of k values."""
        if len(self.sums) <= k:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text or binary column's bytes, end to end, and its n + 1 offsets. Nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `size` bytes of text; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    _, at = text_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` of texts that lie end to end, and n + 1 offsets into those for each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    ink = ~SPACE[data]
    begins, ends = ink.copy(), ink.copy()
    begins[1:] &= ~ink[:-1]
    ends[:-1] &= ~ink[1:]
    inner = at[(at > 0) & (at < len(data))]
    begins[inner] = ink[inner]
    ends[inner - 1] = ink[inner - 1]
    start, end = np.nonzero(begins)[0], np.nonzero(ends)[0] + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Hashes of the words, some at a time, so that arrays of a value a byte stay small."""
    out = np.empty(len(start), np.uint64)
    for i in range(0, len(start), step):
        a, b = start[i : i + step], end[i : i + step]
        out[i : i + step] = Rolling(BYTE_VALUES[data[a[0] : b[-1]]]).ranges(a - a[0], b - a[0])
    return out


def runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    if not len(group):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.nonzero(group[1:] != group[:-1])[0] + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(group)]])


def spans(count: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n of count, end to end."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count)


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n items lie in any of the ranges."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours: block prefixes against block suffixes."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % w
    block = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])
