"""What the operators share: input columns, worker code, batches and files in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintara.storage import shared_folder

BATCH_ROWS = 512
#: A key with more than this share of all rows is frequent; so there are fewer than its inverse.
FREQUENT = 1 / 1000
#: Parts of a key's values that are shuffled one after another.
SLICES = 4


def text_rows(frame: DataFrame, key: str, text: str, *others: str) -> DataFrame:
    """The key, the text with null as empty, and the named other columns; nothing else, whatever the input holds."""
    return frame.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
                        *[F.col(f"`{name}`") for name in others])


def with_workers(spark: SparkSession) -> None:
    """Let Python workers import this package, and hand them batches that stay small for long texts.

    The package is sent with the job, so executors need no copy of it. Batches are limited by rows and,
    where Spark has the setting, by bytes.
    """
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    if getattr(context, "_vintara_sent", False):
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="vintara-code-")) / "vintara_code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted((root / "vintara").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(str(archive))
    context._vintara_sent = True


def released() -> None:
    """Give memory that ended work left in this worker back to the system; a worker serves one operator after another."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def output_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for binary files, below the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write rows once to the shared folder and read them from there: cuts lineage, survives lost executors."""
    path = output_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a write go when it ends; else they stay until the driver happens to collect its garbage, so disk adds up over the writes."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def slice_of(value: Column, number: int) -> Column:
    """Whether a value is of a slice; the values are dealt evenly to ``SLICES``."""
    return F.pmod(F.xxhash64(value, F.lit(SLICES)), F.lit(SLICES)) == number


def in_slices(part: Callable[[int], DataFrame], name: str) -> DataFrame:
    """The rows of ``part(0)`` to ``part(SLICES - 1)``, each stored before the next is shuffled, so that one slice's shuffle is on disk at a time."""
    return reduce(DataFrame.unionAll, [stored(part(number), name) for number in range(SLICES)])


def with_each(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Rows joined to the one row that ``few`` has for their key; frequent keys, of which there are under 1,000, are not shuffled."""
    total = rows.count()
    often = stored(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > total * FREQUENT).select(key), "often")
    hot = rows.join(F.broadcast(few.join(F.broadcast(often), key, "left_semi")), key)
    rest = rows.join(F.broadcast(often), key, "left_anti")
    return hot.unionByName(rest.join(few, key))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with ``pos``, their place in their group from 0, and ``total``, its size; one range shuffle."""
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    ranged = stored(ranged.withColumn("_tag", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_tag", 33)), "ranged")
    runs = ranged.groupBy(group, "_task").agg(F.min("_tag").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(F.col(group).alias("_group"), F.col("_task").alias("_of"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                         F.sum("_n").over(Window.partitionBy(group)).alias("total"))
    joined = ranged.join(starts, (F.col(group) == F.col("_group")) & (F.col("_task") == F.col("_of")))
    return joined.withColumn("pos", F.col("_tag") + F.col("_shift")).drop("_tag", "_task", "_group", "_of", "_shift")


def opened(uri: str):
    """File system and path of a URI, with a helper for local and remote stores alike."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def code_points(text: Column) -> Column:
    return F.length(text).cast("long")


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo the divisor: the stated folds."""
    return F.crc32(key.cast("string").cast("binary")) % divisor


def small_lots(sizes: np.ndarray, limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to the limit at most, one row at least."""
    start, total = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield start, row
            start, total = row, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


def lots(batch: pa.RecordBatch, column: int = 1, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in lots of bounded size of its text column."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    for a, b in small_lots(sizes, limit):
        yield batch.slice(a, b - a)


def large_lots(batches: Iterator[pa.RecordBatch], limit: int, column: int = 1) -> Iterator[list[pa.RecordBatch]]:
    """Batches with rows, in runs whose text columns reach about ``limit`` bytes; a run takes the batch that fills it whole."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def text_lots(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """Keys and texts of a batch (columns 0 and 1) in lots of bounded size."""
    for lot in lots(batch):
        yield lot.column(0), lot.column(1).to_pylist()
