"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words (space, tab to carriage return), as a Java character class.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
#: Keys (longs) of an anti join that may be broadcast, some 20 MB.
MOST_KEYS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent (local runs, tests) a temporary folder of this machine takes its place.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = getattr(spark, "_tidemark_shared", None)
        if path is None:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            path = spark._tidemark_shared = "file://" + tempfile.mkdtemp(prefix="tidemark-")
            spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: later uses do not compute it again."""
    path = os.path.join(shared_dir(df.sparkSession), f"tidemark-{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table from written() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for file in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is not in gone, a frame of one long column; rows with a null key stay.

    gone is written and counted: up to MOST_KEYS keys are sent to every executor, so that df stays where it is; more are
    joined by a shuffle.
    """
    keys = written(gone.toDF("__gone"), "gone")
    side = F.broadcast(keys) if keys.count() <= MOST_KEYS else keys
    return df.join(side, F.col(f"`{key}`").cast("long") == F.col("__gone"), "left_anti")


@cache
def _trim() -> Callable[[int], int] | None:
    """The C library's malloc_trim, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give memory that is no longer used back to the system: a Python worker is kept for later tasks, and beside others."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose text or list column holds about max_bytes at most (one row at least)."""
    if not batch.num_rows:
        return
    held = batch.column(column)
    sizes = pc.multiply(pc.list_value_length(held), 4) if pa.types.is_list(held.type) else pc.binary_length(held)
    sizes = np.asarray(pc.fill_null(sizes, 0), dtype=np.int64)
    group = np.cumsum(sizes) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
    release()


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def hex_of(text: Column) -> Column:
    """Lower-case hex SHA-256 of a text's UTF-8 bytes."""
    return F.sha2(text, 256)
