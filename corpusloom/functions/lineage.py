"""Cutting lineage in loops, the folder that all executors share, and spreading small inputs over all cores."""

from __future__ import annotations

import tempfile
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

#: Inputs below so many bytes for each core are dealt over all cores.
SMALL = 16 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one for the session, if Spark runs in one local process."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that all executors share (``spark.checkpoint.dir``), and read from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def cut_at_once(*frames: DataFrame) -> list[DataFrame]:
    """Each of ``frames`` as :func:`cut_lineage` gives it; jobs that do not wait for each other run side by side."""
    context = frames[0].sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(frames[0].sparkSession))
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(cut_lineage, frames))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is small: a file of one row group is one task, however much work its rows are.  Large inputs have enough parts and stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL * cores else df
