"""What the operators share: the shared folder, table reading, and word hashing on Arrow buffers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset a local folder is made and set, but only if
    driver and executors are one process, as in tests; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lakeforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lakeforge-{uuid.uuid4().hex}"


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """While it holds, Python workers get this many whole texts at a time, which bounds what a task has in memory."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def text_session(spark: SparkSession, rows: int = 1000) -> None:
    """For programs, not for operators: whole texts can be long, so a session that still has Spark's default number of
    rows in a batch for Python workers gets a smaller one. The registered queries and the pipeline are such programs."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, str(rows))


def release() -> None:
    """Give memory that a Python worker has freed back to the machine; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library: its own policy holds
    _libc = None


def per_batch(kind, make, columns: int = 1):
    """A function of columns over Arrow batches. ``make()`` is called once in each task and returns the function for one
    batch; what that holds goes with the task."""

    def one_column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = make()
        for batch in batches:
            yield one(batch)
            del batch
            release()
        del one
        gc.collect()
        release()

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        one = make()
        for batch in batches:
            yield one(*batch)
            del batch
            release()
        del one
        gc.collect()
        release()

    return F.arrow_udf(one_column if columns == 1 else several, kind)


def staged(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    path = f"{folder}/{name}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(spark: SparkSession, value, held: contextlib.ExitStack):
    """A broadcast that goes when ``held`` ends."""
    out = spark.sparkContext.broadcast(value)
    held.callback(out.destroy)
    return out


def dropped(spark: SparkSession, folder: str) -> None:
    """Remove a folder of staged tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------------------------------------------------------
# Words and their hashes, computed on the UTF-8 bytes of a whole Arrow column at once.

TILE = 1 << 20
_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE, np.uint64))))
            self.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _INVERSE, np.uint64))))
        return self.up, self.down


_powers = _Powers()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column without copying; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(offsets) else (data[:0], np.zeros(1, np.int64))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def byte_class(accept) -> np.ndarray:
    """A lookup table over the 256 byte values."""
    return np.fromiter((accept(b) for b in range(256)), bool, 256)


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of word bytes inside a row, and for each row its first word (length rows + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = is_word[data]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    first[inner] = mask[inner]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = mask[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, codes: np.ndarray = _BYTE_CODE) -> np.ndarray:
    """64-bit hash of each word: differences of prefix polynomials, taken over tiles of bounded size. Other ``codes`` of the
    bytes give another hash."""
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(stops, starts[a] + TILE, "right")))
        base, end = int(starts[a]), int(stops[b - 1])
        up, down = _powers.upto(end - base + 1)
        prefix = np.zeros(end - base + 1, np.uint64)
        np.cumsum(codes[data[base:end]] * up[: end - base], out=prefix[1:])
        s, e = starts[a:b] - base, stops[a:b] - base
        out[a:b] = mix((prefix[e] - prefix[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return out


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive words that start at each position; shorter by k - 1 than its input."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = words[:n].copy()
    for i in range(1, k):
        acc = acc * _BASE + words[i : n + i]
    return mix(acc + np.uint64(k))


def slices(offsets: np.ndarray, most: int = 4 << 20):
    """Ranges of rows of at most ``most`` bytes each, a longer row alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def string_list(parts: list[list[str]]) -> pa.Array:
    return pa.array(parts, pa.list_(pa.string()))


# ---------------------------------------------------------------------------------------------------------------
# Filters of bounded size; a false positive only sends more rows to the exact step behind them.

#: Logarithms of the least and greatest size of a filter in bits; between them it follows what it has to hold.
SMALL, LARGE = 16, 27


def log_size(bits: float) -> int:
    return int(min(LARGE, max(SMALL, np.ceil(np.log2(max(bits, 1))))))


class Bits:
    """A filter of 64-bit hashes: one bit for each value of their first ``log`` bits."""

    def __init__(self, log: int, data: np.ndarray):
        self.log, self.data = log, data

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.log)).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        s = self.slot(hashes)
        return ((self.data[s >> 3] >> (s & 7).astype(np.uint8)) & 1).astype(bool)


#: Bits of a filter that is made of a column's values; false positives are dropped by the join that follows.
FILTER_BITS = 1 << 23


def slot(*columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))


def bit_filter(values: DataFrame) -> np.ndarray:
    """A bit for the slot of each row: at most FILTER_BITS / 64 numbers come to the driver."""
    slots = values.select(slot(*values.columns).alias("s")).distinct()
    words = slots.groupBy(F.floor(F.col("s") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["w"].to_numpy(int)] = words["bits"].to_numpy()
    return out


def marked(bits: np.ndarray, slots: pa.Array) -> pa.Array:
    s = slots.to_numpy(zero_copy_only=False)
    return pa.array(((bits[s // 64] >> (s % 64)) & 1).astype(bool))
