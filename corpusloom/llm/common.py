"""Shared helpers of the training-data operators: the shared scratch folder and safe column names."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What splits words when a contract says ``[^\x20\x09-\x0D]+``; also what ``bytes.split()`` splits at.
ASCII_SPACE = "[\\x20\\x09-\\x0D]"


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder is made and kept for the session, but only if Spark runs
    in one local process; on a cluster the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/corpusloom/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, collect: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor costs nothing.

    Spark deletes the shuffle files of a finished job when the driver's JVM collects its garbage, which may not come before
    the next step has filled the disk with its own; so it is asked to, twice, as the first time only frees what holds them.
    Small tables of a loop go without (``collect``).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    for _ in range(2 if collect else 0):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    root = scratch_root(spark)
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if root.split("://")[-1].lstrip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(run):
    """For generators that run in Python workers: at a task's end the worker gives its free memory back, as it stays for later tasks beside the JVM."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library: nothing to give back by hand
                pass

    return wrapped


def own_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, so that extra columns cannot clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def doc_fold(doc_id: Column, folds: int = 5) -> Column:
    """``crc32`` of the id as text, modulo ``folds`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
