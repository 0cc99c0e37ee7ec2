"""Helpers shared by the corpus operators: session, durable intermediates, and byte arrays."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: blank, and U+0009 to U+000D.
WORD_SPACE = "[\\x20\\x09-\\x0D]+"
NULL_ID = np.iinfo(np.int64).min


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Only a local session without that setting (a test) gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="affinis-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, stored in the shared folder; lineage ends there, so a lost executor costs nothing that came before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to a Parquet table in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shuffled_once(df: DataFrame) -> DataFrame:
    """The rows of df for several actions, which read the files of the same shuffle instead of making them again each."""
    frame = df._jdf
    plan = df.sparkSession._jsparkSession.internalCreateDataFrame(frame.queryExecution().toRdd(), frame.schema(), False)
    return DataFrame(plan, df.sparkSession)


def small_batches(spark: SparkSession, bytes_: str = "4m", rows: int = 4096) -> None:
    """Bounds what one Arrow batch holds, for operators that lay out arrays over a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", bytes_)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker that goes on to other tasks gives freed memory back to the system."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library on Linux
            if trim:
                trim(0)

    return inner


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def even_keys(spark: SparkSession, parts: int) -> list[int]:
    """For each partition of repartition(parts, key) a key that goes there, so that lots dealt by hand are even.

    One small number a partition; should a partition have no key among those tried, another one's is used.
    """
    place = F.pmod(F.hash("id"), F.lit(parts))
    rows = spark.range(0, 32 * parts, numPartitions=1).groupBy(place.alias("p")).agg(F.min("id").alias("k")).collect()
    found = {r["p"]: r["k"] for r in rows}
    spare = min(found.values())
    return [found.get(p, spare) for p in range(parts)]


def ascii_lower(c: Column) -> Column:
    """A-Z become a-z; no other character changes."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def crc_of_id(c: Column) -> Column:
    """crc32 of the id's decimal text, the fold rule of the held-out contracts."""
    return F.crc32(c.cast("string").cast("binary"))


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """int64 ids; a null id is NULL_ID."""
    return column.cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)


def ids_back(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the offsets between them; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, off, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    buf = np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
    return buf, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


@functools.cache
def byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


@functools.cache
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers_for(base: int, n: int) -> np.ndarray:
    """At least n powers of an odd base modulo 2**64, cached by size class."""
    return powers(base, max(1 << 16, 1 << int(n).bit_length()))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


HASH_BASE = 0x9E3779B97F4A7C15
HASH_INVERSE = pow(HASH_BASE, -1, 1 << 64)


def prefix_sums(buf: np.ndarray, seed: int = 7) -> np.ndarray:
    """S[i] = sum over j < i of table[byte j] * base**j, modulo 2**64."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(byte_table(seed)[buf] * powers_for(HASH_BASE, len(buf))[: len(buf)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, the same for equal bytes anywhere."""
    return mix64((sums[end] - sums[start]) * powers_for(HASH_INVERSE, len(sums))[start])


@functools.cache
def space_table() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and how many words lie before each row's start."""
    n = len(buf)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~space_table()[buf]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inside[firsts]  # words end with their row
    starts = np.flatnonzero(begins)
    last = np.zeros(n + 1, bool)
    last[1:] = inside[:n] & ~inside[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]]
    last[lasts] = inside[lasts - 1]
    return starts, np.flatnonzero(last), np.searchsorted(starts, offsets)
