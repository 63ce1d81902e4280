"""What the operators share: durable intermediates and row-shaped helpers."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import os
import sys
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.batches import small_batches  # noqa: F401  operators take it from here

#: Id lists of at most this many rows may be broadcast (16 bytes a row in Spark's long map).
BROADCAST_IDS = 1_000_000

_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where it is unset, a folder of this machine, but only in local mode, where
    driver and executors are one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = os.path.join(os.getcwd() if not os.access("/tmp", os.W_OK) else "/tmp", f"lectern-{os.getpid()}")
    return path.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/lectern-{what}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone at exit
        return


def delete(spark: SparkSession, path: str) -> None:
    """Remove an intermediate that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage; the files outlive any executor.
    """
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of intermediates that nothing will read any more."""
    for df in frames:
        _, path = _PATHS.pop(id(df))
        delete(df.sparkSession, path)


def give_back() -> None:
    """Return what this worker has freed to the system."""
    pyarrow.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable) -> Callable:
    """A function over Arrow batches that gives its worker's memory back to the system when a task ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        give_back()

    return wrapped


def between(batches: Iterator) -> Iterator:
    """The batches, with memory given back after each, for functions that keep a few large tables beside many short-lived arrays.

    Arrays of a megabyte and more get mappings of their own, which end with them.
    """
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "mallopt"):
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD; glibc raises it to 32 MB where it is not set
    for batch in batches:
        yield batch
        del batch
        give_back()


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keep_ids(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Semi- or anti-join by ``column``: broadcast while ``ids`` is counted to be small, else a shuffled join."""
    ids = ids.select(column)
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, how)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket_of_id(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))


def drawn(df: DataFrame, column: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the least hashes of ``column``; what tasks send is bounded in all, not each."""
    key = F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(1 << 40))
    share = min(1.0, 2 * most / max(1, df.count()))
    return df.where(key < int(share * (1 << 40)) + 1).orderBy(key, column).limit(most)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
