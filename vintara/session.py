"""A local Spark session with the settings the jobs are tuned for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str | None = None, app: str = "vintara") -> SparkSession:
    cores = cpus or os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="vintara-session-")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", scratch)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
