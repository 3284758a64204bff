"""What several operators use: tables, shared folders, Arrow buffers, hashing of bytes and words."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that the vectorised kernels take at once (one document may be longer).
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, below spark.checkpoint.dir. Where that is unset a local session gets a temporary folder; on a cluster that would not be shared, so it is an error there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share.")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/lectern-shared"
    return f"{base.rstrip('/')}/lectern-{uuid.uuid4().hex}"


def stored(df: DataFrame, *, large: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it back, so the planner knows its true size. What is read from it is lazy, so the folder stays as long as the session (`clear`). large: the shuffles that made it take much disk, so they are let go at once."""
    spark, schema, path = df.sparkSession, df.schema, shared_folder(df.sparkSession)
    df.write.parquet(f"{path}/table")
    _WRITTEN.append(path)
    if large:
        del df
        let_go(spark)
    return spark.read.schema(schema).parquet(f"{path}/table")


def let_go(spark: SparkSession) -> None:
    """Has the driver collect its garbage: that is when Spark's cleaner deletes the files of shuffles that nothing refers to any more. The pause is for the thread that passes Python's own garbage on."""
    gc.collect()
    for pause in (1.3, 0.2):  # the first collection lets go of the objects that hold what the second one is for
        time.sleep(pause)
        spark.sparkContext._jvm.System.gc()


_WRITTEN: list[str] = []


def clear(spark: SparkSession) -> int:
    """Deletes the tables that `stored` has written so far, once what was read from them is no longer needed; returns how many."""
    many = len(_WRITTEN)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
    return many


#: Bytes of a batch of rows, about, that goes to a Python worker. The buffers of such batches lie outside the JVM's heap, where nothing else bounds them.
BATCH_BYTES = 2 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's batches to Python workers by bytes, where it has no bound of its own."""
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, f"{BATCH_BYTES}b")


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(kernel: Kernel) -> Kernel:
    """The kernel, after whose task the worker, which outlives it, gives the memory back that it has freed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)


def spare(columns: list[str], *names: str) -> list[str]:
    """Names like those given that no column has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- Arrow -----------------------------------------------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with up to `most` bytes; a longer row is a run of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from concatenated values and the rows' counts."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


# --- hashing ---------------------------------------------------------------------------------------------------------

#: The constants of the public splitmix64 generator.
_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_BASE = int(mix(np.array([77], np.uint64))[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0], _POWERS[1]


class Rolling:
    """Polynomial hashes of any substring of some bytes, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, values: np.ndarray = _BYTE):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, k: int) -> np.ndarray:
        """Of all substrings of length k."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


_LOWER_BYTE = _BYTE[_LOWER]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word `[^\\x20\\x09-\\x0D]+`; no word crosses rows. offsets[0] is 0."""
    if len(data) == 0:
        return (np.zeros(0, np.int64),) * 3
    inside = ~_SPACE[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | first))
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    last = np.zeros(len(data), bool)
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    end = np.flatnonzero(inside & (~after | last)) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words with A-Z lower-cased."""
    return Rolling(data, _LOWER_BYTE).of(start, end)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
