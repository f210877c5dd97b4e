"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as everywhere in this subpackage: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one Arrow batch may hold on its way to a Python worker.
BATCH_BYTES = 4 << 20

#: Bytes that one task of a shuffle gets at most, where the size of what is shuffled is known.
PART_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns and the text, null texts as empty ones. Other columns can't clash with what follows."""
    return df.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds by bytes as well as by rows; a user's smaller bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.fullmatch(r"(\d+)b?", str(spark.conf.get(key)).strip().lower())
    if not held or not 0 < int(held[1]) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow or an iterator UDF; when its task ends, the worker, which stays for other tasks, gives its free
    memory back to the system."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def parts_for(spark: SparkSession, size: int, least: int = 1) -> int:
    """Tasks for a shuffle of `size` bytes: PART_BYTES each at most, and at least spark.sql.shuffle.partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def plan_bytes(df: DataFrame) -> int:
    """Bytes that df reads, as the files' sizes tell; no job runs. 0 where nothing tells."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines see; where unset, one of our own if all is on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        import tempfile

        at = "file://" + tempfile.gettempdir() + "/loomgraph-shared"
    return at.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    The files go when the session ends, or by `discard`.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    atexit.register(_remove, spark, at)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that `materialise` wrote, once nothing reads it any more."""
    _remove(df.sparkSession, df.written_at)


def _remove(spark: SparkSession, at: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session, and with it the JVM, may have ended before
        pass
