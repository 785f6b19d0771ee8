"""Shared pieces: texts as flat byte arrays, their hashes, and durable intermediate tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..storage import materialize as materialize

#: Bytes that separate words: space and the controls 9 to 13.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def release() -> None:
    """Give freed memory back to the system.  Spark keeps Python workers for later tasks, so what an idle one still
    holds stands beside what the busy ones need."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function of batches that releases its task's memory when it ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def tidy_group(run: Callable) -> Callable:
    """As ``tidy``, for a function of one group's table."""

    def wrapped(rows):
        try:
            return run(rows)
        finally:
            release()

    return wrapped


def tidy_groups(run: Callable) -> Callable:
    """As ``tidy``, for a function of the tables of two groups."""

    def wrapped(left, right):
        try:
            return run(left, right)
        finally:
            release()

    return wrapped


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, n + 1) and bytes of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at, raw


def slices(offsets: np.ndarray, limit: int = 1 << 20):
    """Row ranges whose bytes stay under ``limit``; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def prefix(values: np.ndarray) -> np.ndarray:
    """Running sums with a zero in front."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class RollingHash:
    """Hashes of any byte ranges of a buffer from running sums of ``table[byte] * base**position`` modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15 | 5

    def __init__(self, seed: int = 7):
        self.table = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if n <= len(self.powers):
            return
        n = max(n, 1 << 16)
        up, down = np.full(n, self.BASE, np.uint64), np.full(n, pow(self.BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.powers, self.inverse = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._reach(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.inverse[start]
