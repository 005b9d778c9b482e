"""Words of whole texts as numpy arrays: spans, owners and 64-bit hashes, a few rows at a time.

Hashes depend on bytes alone, so every task and every run agrees on them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_draws = np.random.default_rng(20)
_BYTE = _draws.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = _draws.integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)

#: Space and the control characters from tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: All but ASCII letters and the bytes of characters beyond ASCII.
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers in which every bit depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """What :func:`mix` made these numbers of."""
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * _UNMIX[0]
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * _UNMIX[1]
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


_UNMIX = [np.uint64(pow(x, -1, 1 << 64)) for x in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]


class _Powers:
    """Powers of the hash's base and of its inverse, as many as the longest slice needed so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SLICE_BYTES * 5 // 4)
            cls.up, cls.down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (_BASE, _BASE_INVERSE)
            )
        return cls.up, cls.down


@dataclass
class Texts:
    """The texts of rows ``start`` to ``stop`` of a batch: their bytes end to end, and where each begins."""

    start: int
    stop: int
    buf: np.ndarray
    at: np.ndarray

    @property
    def rows(self) -> int:
        return self.stop - self.start


def give_back() -> None:
    """Returns memory that is free but kept to the system, as Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Whole texts of a string column, about ``limit`` bytes at a time; a null text is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        stop = min(stop, n)
        yield Texts(start, stop, buf[at[start] : at[stop]], at[start : stop + 1] - at[start])
        start = stop
    give_back()


@dataclass
class Words:
    """Words in order: byte spans, the owning row (within the slice) and a hash."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hash: np.ndarray


def spans(texts: Texts, buf: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, and their rows."""
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[texts.at] = True
    inside = ~separators[buf]
    before = np.concatenate([np.zeros(1, bool), inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], np.zeros(1, bool)]) & ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(texts.at, starts, "right") - 1


class Hasher:
    """Hashes any spans of a slice."""

    def __init__(self, buf: np.ndarray):
        self.up, self.down = _Powers.of(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * self.up[: len(buf)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _PLACE[0])


def words(texts: Texts, fold: np.ndarray = LOWER, separators: np.ndarray = SPACES) -> Words:
    buf = fold[texts.buf]
    starts, ends, row = spans(texts, buf, separators)
    return Words(starts, ends, row, Hasher(buf)(starts, ends))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` neighbours, in their order; fewer than ``size`` give none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * _PLACE[1 + k]
    return mix(total)


def sequence(hashes: np.ndarray) -> np.ndarray:
    """One hash of a whole short sequence."""
    places = _PLACE[1 : 1 + len(hashes)]
    return mix((hashes * places).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(hashes)) * _PLACE[0])


def shingle_sets(texts: Texts, size: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its word windows; a shorter text's whole sequence counts as one."""
    found = words(texts)
    hashes = windows(found.hash, size)
    at = np.searchsorted(found.row, np.arange(texts.rows + 1))
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            yield np.unique(hashes[a : b - size + 1])
        elif b > a:
            yield sequence(found.hash[a:b])
        else:
            yield np.empty(0, np.uint64)
