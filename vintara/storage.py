"""Durable intermediate results in the folder all executors share.

Lineage is cut only by writing: a checkpoint or a parquet table below the
folder named in ``spark.checkpoint.dir``. Losing an executor never loses them.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Rows of a partition that a task sorts in memory, wide rows too.
PART_ROWS = 500_000
#: Spark refuses tables of more buckets.
MOST_PARTS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local session."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    existing = context.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="vintara-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def durable(frame: DataFrame) -> DataFrame:
    """Materialise rows once, so later passes all see the same partitions and values."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(frame: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table to the shared folder and read it back column-pruned."""
    path = fresh_path(frame.sparkSession, name)
    writer = frame.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def parts_for(frame: DataFrame) -> int:
    """Partitions for the frame's rows, never fewer than the session's: their number grows with the rows, not their size.

    Meant for tables as they are stored, whose rows are counted from the file footers.
    """
    least = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(math.ceil(frame.count() / PART_ROWS), MOST_PARTS))


def small_side(frame: DataFrame, limit: int = 100_000) -> DataFrame:
    """Materialise a join side and broadcast it only if its row count allows."""
    kept = durable(frame)
    return F.broadcast(kept) if kept.count() <= limit else kept


def with_counts(frame: DataFrame, metrics: dict[str, Column]) -> tuple[DataFrame, Callable[[], dict]]:
    """The frame with aggregates that its next action measures on the rows it passes on, and a function that returns them afterwards.

    Checks and reports so cost no pass of their own, and count what was really written.
    """
    seen = Observation(f"counts-{uuid.uuid4().hex}")
    return frame.observe(seen, *[c.alias(n) for n, c in metrics.items()]), lambda: dict(seen.get)
