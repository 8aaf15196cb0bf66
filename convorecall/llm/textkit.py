"""Vectorised helpers for whole texts inside Arrow batches.

Everything here works on slices of an Arrow string column as raw UTF-8 bytes, a few megabytes at a time, so the
memory of a worker does not depend on the number of rows in a batch. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 18
#: Powers that a worker keeps; a longer text has its own made for it.
KEPT = (1 << 19) + 1
#: Bytes of one Arrow batch of whole texts: Spark's own bound takes hundreds of megabytes, in the JVM and in Python.
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_RNG = np.random.default_rng(20240517)
_RAW = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = _RAW.copy()
_LOWER[65:91] = _RAW[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    made = []
    for b in (_BASE, _INVERSE):
        p = np.full(max(n, KEPT), b, np.uint64)
        p[0] = 1
        made.append(np.cumprod(p, dtype=np.uint64))
    if n <= KEPT:
        _POWERS[:] = made
    return made[0], made[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: a bijection, so it adds no collisions."""
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def give_back() -> None:
    """Return freed memory to the machine: workers are kept between tasks, and an executor pays for all that they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def sparing(run):
    """``run`` over batches, with freed memory given back after each one and at the end."""

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            give_back()

    def spared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(one_by_one(batches))
        give_back()

    return spared


def map_texts(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of few bytes, giving memory back between them; a session with a smaller bound keeps it."""
    conf = df.sparkSession.conf
    if int(conf.get(_BYTES).rstrip("bB")) > BATCH_BYTES:
        conf.set(_BYTES, str(BATCH_BYTES))
    return df.mapInArrow(sparing(run), schema)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of at most ``limit`` bytes; a longer row stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the rows of one slice: byte bounds, row and a 64-bit hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        n = len(data)
        self.rows = len(offsets) - 1
        solid = ~_SPACE[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        inner = offsets[1:-1]
        inner = inner[inner < n]
        begins[inner] = solid[inner]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        inner = inner[inner > 0] - 1
        ends[inner] = solid[inner]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        bounds = np.searchsorted(self.start, offsets)
        self.first = bounds  # of each row, and the end
        self.row = np.repeat(np.arange(self.rows), np.diff(bounds))
        power, inverse = _powers(n + 1)
        table = _LOWER if lower else _RAW
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * power[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of each k-word shingle; a row of 1 to k-1 words has one shingle, all its words."""
        h, first = self.hash, self.first
        counts = np.diff(first)
        n = len(h)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(max(n - k + 1, 0), np.uint64)
        for j in range(k):
            total = total * np.uint64(0xD6E8FEB86659FD93) + mix(h[j : j + len(total)] + np.uint64(j + 1))
        keep = np.zeros(len(total), bool)
        if len(total):
            keep = self.row[: len(total)] == self.row[k - 1 :]
        row, out = self.row[: len(total)][keep], mix(total[keep])
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            extra = np.array([self._whole(first[r], first[r + 1]) for r in short], np.uint64)
            row, out = np.concatenate([row, short]), np.concatenate([out, extra])
        return row, out

    def _whole(self, lo: int, hi: int) -> int:
        x = int(hi - lo)
        for v in self.hash[lo:hi].tolist():
            x = (x * 0xA0761D6478BD642F + v + 1) & 0xFFFFFFFFFFFFFFFF
            x ^= x >> 31
        return x


def distinct_pairs(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, in order of row, then value."""
    order = np.argsort(value, kind="quicksort")
    order = order[np.argsort(row[order], kind="stable")]
    row, value = row[order], value[order]
    if len(row):
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[keep], value[keep]
    return row, value


def string_column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    """A string column as one array."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
