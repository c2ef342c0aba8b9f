"""Vectorised helpers over the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the polynomial hashes.
WORD_P, SEQ_P = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, U64)
        out[0] = 1
        return np.multiply.accumulate(out)


def inverse(base: np.uint64) -> np.uint64:
    return U64(pow(int(base), -1, 1 << 64))


class Rolling:
    """Hashes of any range of a sequence of 64-bit values, from prefix sums of value * base^i."""

    def __init__(self, base: np.uint64 = SEQ_P):
        self.base, self.n = base, 0

    def _grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 12)
            self.up, self.down = powers(self.base, self.n), powers(inverse(self.base), self.n)

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts have length 0."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def groups(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of one have about most bytes (a longer text stands alone, whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = buffers(batch.column(text))
        cuts, begun = [0], 0
        for i in np.flatnonzero(np.diff(at // most)) + 1:
            if i > cuts[-1]:
                cuts.append(int(i))
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def words(raw: np.ndarray, at: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of the words, and the index of each text's first word. inside: bytes of words, by default all but ASCII white space."""
    ok = inside[raw] if inside is not None else ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], ok[:-1])) if len(raw) else ok
    starts = np.flatnonzero(ok & (~before | edge[:-1]))
    after = np.concatenate((ok[1:], [False])) if len(raw) else ok
    ends = np.flatnonzero(ok & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    up = (raw >= 65) & (raw <= 90)
    return np.where(up, raw + np.uint8(32), raw)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, rolling: Rolling, block: int = 1 << 17) -> np.ndarray:
    """A 64-bit hash of each word, in blocks of about block bytes, so that long texts need no more memory: a byte takes over 50 while it is hashed."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, side="right")))
        begin = starts[i]
        sums = rolling.sums(raw[begin : ends[j - 1]].astype(U64) + U64(1))
        out[i:j] = rolling.ranges(sums, starts[i:j] - begin, ends[i:j] - begin)
        i = j
    return out


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The whole numbers of each range start, start + 1, … of its size, one range after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def texts(raw: np.ndarray, at: np.ndarray) -> Iterator[bytes]:
    data = raw.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield data[a:b]


def give_back() -> None:
    """Return the memory that a task has freed to the system: its worker process goes on to other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a task's pass over batches, with what it held given back when it ends."""

    @functools.wraps(run)
    def whole(batches):
        yield from run(batches)  # run's own variables are gone by then
        give_back()

    return whole
