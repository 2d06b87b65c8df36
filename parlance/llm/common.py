"""Shared helpers of the training-data operators.

Text is handled as the raw UTF-8 buffer of an Arrow column: words, hashes and
windows of a whole batch are computed at once with numpy, without a Python
object for each word.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parlance.session import remove, scratch, ship

#: Text bytes that one numpy kernel call works on; a longer document is a call of its own.
SLICE_BYTES = 1 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers and bound the Arrow batches they get."""
    ship(spark)
    # freed Arrow and numpy buffers go back to the system: workers outlive their tasks
    spark.sparkContext.environment.update({"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "33554432"})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table of the shared folder and read it again: later jobs need no executor that made it."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _LEFT[path] = spark
    again = spark.read.schema(df.schema).parquet(path)
    again._scratch_path = path
    return again


def drop(*tables: DataFrame) -> None:
    """Remove tables that `cut` wrote, once nothing reads them any more."""
    for t in tables:
        _remove(t._scratch_path)


@contextlib.contextmanager
def held(*tables: DataFrame):
    """Remove, at the end, the tables that `cut` wrote within the block, but for those put into the list that it gets; and `tables`."""
    before, stay = set(_LEFT), []
    yield stay
    stay = {t._scratch_path for t in stay}
    gone = {p for p in _LEFT if p not in before and p not in stay} | {t._scratch_path for t in tables}
    for path in gone:
        _remove(path)


def _remove(path: str) -> None:
    remove(_LEFT.pop(path), path)


def release(spark: SparkSession) -> None:
    """Let the shuffle files of finished jobs go now: Spark removes them once their plans are collected as garbage, which the driver does rarely."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_LEFT: dict[str, SparkSession] = {}


@atexit.register
def _clean() -> None:
    """Remove what lazily read results still needed; a session that has ended leaves it to the folder's own cleaning."""
    for path, spark in list(_LEFT.items()):
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                remove(spark, path)


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """(first row, bytes, offsets from 0) of consecutive rows of a string column; null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, buf[off[i] : off[j]], (off[i : j + 1] - off[i]).astype(np.int64)
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(1 << max(10, math.ceil(math.log2(n))), _BASE, np.uint64)
        p[0] = 1
        _POWERS = np.cumprod(p, dtype=np.uint64)
    return _POWERS


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the runs without ASCII white space; none crosses a row."""
    ink = ~_SPACE[buf]
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    end = ink.copy()
    end[:-1] &= ~ink[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    both = inner[ink[inner] & ink[inner - 1]]
    start[both] = True
    end[both - 1] = True
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each of the given byte spans (none empty), by their bytes and length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    rel = np.arange(int(size.sum())) - np.repeat(first, size)
    b = buf[rel + np.repeat(start, size)]
    if lower:
        b = _LOWER[b]
    h = np.add.reduceat(_BYTE[b] * powers(int(size.max()) + 1)[rel], first)
    return mix(h + size.astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def words_of(buf: np.ndarray, off: np.ndarray, lower: bool = False):
    """(hash of each word, number of each row's first word with the total appended, starts, ends)."""
    start, end = word_bounds(buf, off)
    return span_hashes(buf, start, end, lower), np.searchsorted(start, off), start, end


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows inside each row, and the first word of each."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    p = powers(k + 1)
    w = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        w += h[i : n - k + 1 + i] * p[i]
    row_end = np.repeat(first[1:], np.diff(first))[: n - k + 1]
    at = np.flatnonzero(np.arange(n - k + 1) + k <= row_end)
    return mix(w[at]), at
