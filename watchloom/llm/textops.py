"""Shared pieces of the text operators: words, hashed shingles, checkpoints.

A *word* is a maximal run of characters outside ``\\x20 \\x09-\\x0D``.  On UTF-8
bytes that is exactly ``bytes.split()``, which is why the helpers below work on
bytes.  All functions that run inside tasks take and return numpy arrays for a
bounded piece of work (one Arrow batch at a time).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries a worker's word cache may hold before it is emptied (about 100 B each).
CACHE_WORDS = 150_000
#: Bytes of the batches that go to and from a worker; Spark's own bound of 64 MB is seldom met before its 10 000 rows.
BATCH_BYTES = 4 << 20

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered per worker and emptied when full."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def finish(h: np.ndarray) -> np.ndarray:
    """Spread the bits of linear combinations (a 64-bit finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def window_hashes(w: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of every run of ``size`` words, in order; empty if there are fewer."""
    n = len(w) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = w[:n] * _MIX[0]
    for i in range(1, size):
        h = h + w[i : i + n] * _MIX[i % 5] + np.uint64(i)
        h = (h << np.uint64(7)) | (h >> np.uint64(57))
    return finish(h)


def shingle_set(w: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles; a text of fewer words has its whole sequence as one, an empty text none."""
    if len(w) == 0:
        return np.empty(0, np.uint64)
    if len(w) < size:
        return window_hashes(w, len(w)) ^ np.uint64(len(w))
    return np.unique(window_hashes(w, size))


def hash_functions(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """k pairs (xor, odd multiplier) of 32-bit hash functions, from a seed."""
    r = np.random.default_rng(seed)
    return r.integers(0, 2**32, k, dtype=np.uint32), r.integers(0, 2**32, k, dtype=np.uint32) | np.uint32(1)


def utf8(col: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts of an Arrow column as bytes; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return [x or b"" for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, most_bytes: int = 4 << 20, most_rows: int = 2000) -> Iterable[pa.RecordBatch]:
    """Slices of a batch of about most_bytes of its own buffers, so that a task's memory doesn't follow the batch.

    What Arrow keeps of earlier batches is given back first: workers outlive their
    tasks and stages, and an executor has several of them.
    """
    pa.default_memory_pool().release_unused()
    n = batch.num_rows
    if not n:
        return
    step = max(1, min(most_rows, int(n * most_bytes / max(1, batch.nbytes))))
    for i in range(0, n, step):
        yield batch.slice(i, step)


def bounded_batches(spark: SparkSession) -> None:
    """From now on this session's batches end at BATCH_BYTES, or at a row that is longer.

    A batch lies in the JVM (outside its heap, in buffers that double) and in the
    worker at once, for each task of an executor, and what they once grew to they keep.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; set to an own one only where it is unset (tests on one machine)."""
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="watchloom-", dir=os.environ.get("WATCHLOOM_TMP"))
    sc.setCheckpointDir(conf)
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """df written as a table in the shared checkpoint folder and read from there.

    Survives lost executors and cuts lineage.  Unlike checkpoint(), whose result
    keeps the plan's estimated sizes (they multiply over the joins of a loop), the
    written table has its real size.  The tables stay in a folder of the
    application's own, to be cleared with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/watchloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_remainder(col: str, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % m


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
