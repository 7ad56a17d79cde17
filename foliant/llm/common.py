"""Helpers that the training-data operators share.

Scratch tables live in the folder that ``spark.checkpoint.dir`` names, which the driver and every
executor of a cluster share, so a lost executor costs a reread and never a result.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs without ASCII white space, which is what bytes.split() yields.
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Bounds the session's Arrow batches by bytes, as texts may be very long."""
    spark.conf.set(BATCH, "4m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder; one of our own only where a local session names none (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = held or "file://" + tempfile.mkdtemp(prefix="foliant-")
        if not held:
            spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


@contextmanager
def eager_cleanup(spark: SparkSession):
    """Shuffle files of the jobs inside go as soon as each job has ended."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant-{what}-{uuid.uuid4().hex}"
    with eager_cleanup(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._foliant_path = path
    return back


def discard(*dfs: DataFrame) -> None:
    """Delete scratch tables that nothing will read again."""
    for df in dfs:
        path = getattr(df, "_foliant_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def aside(docs: DataFrame, taken: tuple[str, ...]):
    """``docs`` with other names for columns called like those that an operator adds, and the way back."""
    free, own = iter(f"_aside_{i}" for i in range(10**9)), {c.lower() for c in docs.columns}
    names = {c: next(f for f in free if f not in own) for c in docs.columns if c.lower() in taken}
    return docs.withColumnsRenamed(names), lambda df: df.withColumnsRenamed({v: k for k, v in names.items()})


def crc_bucket(col: str, n: int) -> Column:
    """crc32(id as text) mod n, the fold of the contracts; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def crc_mod(key: object, n: int) -> int:
    """The same fold on the Python side."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % n


class WordCache(dict):
    """word -> value; computes what is missing and keeps at most ``cap`` words."""

    def __init__(self, compute, cap: int = 200_000):
        super().__init__()
        self.compute, self.cap = compute, cap

    def __missing__(self, word):
        value = self.compute(word)
        if len(self) < self.cap:
            self[word] = value
        return value


def word_hashes(words: list[bytes], cache: WordCache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def hash_cache(cap: int = 200_000) -> WordCache:
    return WordCache(xxhash.xxh3_64_intdigest, cap)


MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(31))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX2
    return x ^ (x >> np.uint64(32))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes (Horner form, then mixed); empty if fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, n):
        out *= MIX
        out += h[j : j + m]
    return mixed(out)


def released() -> None:
    """Give memory that this worker no longer uses back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def sliced(batches, rows: int = 1_000):
    """Arrow batches cut into short ones, so that few Python objects live at a time."""
    released()
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    released()


def texts(batch, name: str) -> list:
    """A string column of an Arrow batch as UTF-8 bytes (None for null)."""
    return batch.column(name).cast(pa.binary()).to_pylist()
