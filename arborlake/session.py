"""Session helpers shared by the iterative operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a local
    master, where every task runs on this machine, falls back to a temporary one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="arborlake-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably so that the plan of the next round starts here.

    The rows become a Parquet table in the shared folder: they survive lost executors, later steps read only
    the columns they need, and the planner knows their size in files. That is far less than in memory, so a join of such
    tables that grow with the input is one by :func:`join_large`.
    All tables of an application lie in one folder with its id, which can go when the application has ended.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/step-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "lz4").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def few_listers(spark: SparkSession) -> Iterator[None]:
    """Folders listed by some tasks a core while tables are opened; a task for every folder would be mostly waiting."""
    tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(tasks)
    spark.conf.set(tasks, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(tasks, before)


ROWS = 1_000_000  # rows of a partition where their number is known


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """Hash ``df`` over all shuffle partitions before a step that multiplies its rows.

    Small rows that grow into many (rings into pixels) are cheap to move beforehand, and a fixed number keeps
    adaptive execution from folding them into a few tasks because they are still small. Where the number of ``rows``
    is known, there are as many partitions as bound the rows of one, however large the input is.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS)), *keys)


def join_large(df: DataFrame, side: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join two sides that both grow with the input, by sorted shuffles.

    The planner guesses a size from compressed files and does not see that rows are multiplied after the scan; it
    would send such a side through the driver as a broadcast. Hot keys are split by adaptive execution.
    """
    return df.hint("merge").join(side, on, how)


SMALL_ROWS = 1_000_000  # narrow rows a broadcast side may have


def join_small(df: DataFrame, side: DataFrame, on: str | list[str], how: str = "inner", max_rows: int = SMALL_ROWS) -> DataFrame:
    """Join a narrow side that usually is small, such as one row per image.

    The side is counted first. Within ``max_rows`` it is broadcast, so a pixel table is not moved and a hot
    image stays spread out; beyond that it is an ordinary join, where adaptive execution splits hot keys.
    """
    small = side.limit(max_rows + 1).count() <= max_rows
    return df.join(F.broadcast(side) if small else side, on, how)
