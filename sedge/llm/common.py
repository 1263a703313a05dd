"""Shared helpers: folders that every executor sees, Arrow batch limits, byte-level numpy tools."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's words: runs of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's spark.checkpoint.dir; it goes when the application ends.

    Where the setting is absent, a local master gets a folder of its own machine; a cluster must name one.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        base = f"file://{tempfile.mkdtemp(prefix='sedge-')}"
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/sedge-{name}-{uuid.uuid4().hex}"
    jvm_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of shared_dir() that no later plan reads."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in a shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner, which waits for garbage collection, delete the shuffle files of finished work."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables in one shared folder that go together when the work that reads them is done."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, shared_dir(spark, name), 0

    def save(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.folder}/{self.n}", self.n + 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete the tables and the shuffles that made them."""
        remove_dir(self.spark, self.folder)
        free_shuffles(self.spark)


#: Rows of a table of a few numbers each that may be broadcast, at most.
LIGHT = 1 << 18


def light_join(rows: DataFrame, few: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """rows joined with few, a written table of a few numbers a row: rows stay where they are if few has LIGHT rows at most."""
    return rows.join(F.broadcast(few) if few.count() <= LIGHT else few, on, how)


ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that long texts don't add up in a Python worker.

    Plans that are returned run later, so this stays set in the session, the same for all operators of this subpackage.
    """
    spark.conf.set(ROWS, 500)
    spark.conf.set(BYTES, "8m")


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Other batches for what runs in this block alone."""
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(ROWS, before)


def trim() -> None:
    """Give free memory back to the system; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


_copies: dict = {}


def worker_copy(key: tuple, make):
    """What make() gives, kept in this Python worker until another operator runs in it: a worker holds one operator's tables."""
    if key not in _copies:
        _copies.clear()
        trim()
        _copies[key] = make()
    return _copies[key]


def drop_copies() -> None:
    """For operators without tables of their own."""
    if _copies:
        _copies.clear()
        trim()


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary Arrow column, end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    buffers = column.buffers()
    n = len(column)
    if n == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind, n + 1, column.offset * kind.itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the contract's words in order, and the n + 1 word offsets of the texts. Words never cross texts.

    Each word's hash is a polynomial in its bytes, from prefix sums modulo 2**64, mixed with its length.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1]
    starts_of_texts = offsets[:-1][offsets[:-1] < n]
    first[starts_of_texts] = inside[starts_of_texts]
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    last = inside.copy()
    last[:-1] &= space[1:]
    ends_of_texts = offsets[1:][offsets[1:] > 0] - 1
    last[ends_of_texts] = inside[ends_of_texts]
    ends = np.flatnonzero(last) + 1
    length = ends - starts
    with np.errstate(over="ignore"):
        out = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        alive, k = np.arange(len(starts)), 0
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        while len(alive):
            # eight bytes at a time; bytes past the word's end are cleared
            at = starts[alive] + 8 * k
            left = np.minimum(length[alive] - 8 * k, 8)
            chunk = np.zeros(len(alive), np.uint64)
            for b in range(8):
                chunk |= np.where(left > b, padded[np.minimum(at + b, n)], 0).astype(np.uint64) << np.uint64(8 * b)
            out[alive] = mixed(out[alive] ^ chunk) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 1)
            k += 1
            alive = alive[length[alive] > 8 * k]
        out = mixed(out)
    return out, np.searchsorted(starts, offsets).astype(np.int64)


def list_array(values: pa.Array | np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values) if isinstance(values, np.ndarray) else values)


class Recent:
    """A cache of two generations: at its limit the younger becomes the elder, and what the elder still serves comes back."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, keys: list, make) -> list:
        """The values of distinct keys; make(missing keys) gives the unknown ones."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found = list(map(young.get, keys))
        if None not in found:
            return found
        new = [k for k, v in zip(keys, found, strict=True) if v is None]
        again = list(map(old.get, new))
        missing = [k for k, v in zip(new, again, strict=True) if v is None]
        made = iter(make(missing) if missing else ())
        values = [next(made) if v is None else v for v in again]
        young.update(zip(new, values, strict=True))
        rest = iter(values)
        return [next(rest) if v is None else v for v in found]
