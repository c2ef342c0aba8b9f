"""A filter of fixed size for 64-bit keys, to leave rows behind before a join on the same keys: what it lets through needlessly the join drops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits of the filter, and bytes of its pages.
SIZE, PAGE = 1 << 23, 4096


def _bits(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.uint64) % np.uint64(SIZE)


def bitmap(keys: DataFrame) -> bytes:
    """keys (key long) -> SIZE bits, set at the keys' places. Pages that have a key are joined on executors; the driver gets SIZE / 8 bytes at most."""
    size = np.uint64(8 * PAGE)

    def batch_of(found: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["page", "bits"])

    def pages(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            place = _bits(batch.column("key").to_numpy())
            for page in np.unique(place // size).tolist():
                set_here = np.zeros(8 * PAGE, bool)
                set_here[(place[place // size == page] % size).astype(np.int64)] = True
                found[page] = found.get(page, 0) | np.packbits(set_here)
        yield batch_of(found)

    def joined(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, bits in zip(batch.column("page").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                found[page] = found.get(page, 0) | np.frombuffer(bits, np.uint8)
        yield batch_of(found)

    out = np.zeros(SIZE // 8, np.uint8)
    for r in keys.select("key").mapInArrow(pages, "page long, bits binary").repartition("page").mapInArrow(joined, "page long, bits binary").collect():
        out[r.page * PAGE : (r.page + 1) * PAGE] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def maybe_in(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Which keys may be among those of the filter: all that are, and few others."""
    place = _bits(keys)
    known = np.frombuffer(bits, np.uint8)[(place >> np.uint64(3)).astype(np.int64)]
    return (known & (np.uint8(0x80) >> (place & np.uint64(7)).astype(np.uint8))) > 0
