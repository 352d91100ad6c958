"""The two tables every later stage reads, written once per session and folder.

* **months**: the loan months, bucketed by loan. Windows and joins per loan then
  start from a co-located scan and need no exchange of the monthly rows.
* **panel**: the months at risk, one folder per cohort, so cohort filters prune files.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from vintara.operators.ordering import SLICE
from vintara.operators.panel import LOAN, build_panel
from vintara.sources import panel_store
from vintara.sources.driver_tables import DRIVER_SETTINGS, loan_book, loan_months, table
from vintara.storage import fresh_path, parts_for


def store_months(months: DataFrame, path: str, buckets: int | None = None) -> str:
    """Write the months bucketed by loan and return the table name.

    Every window on the table runs per bucket, so ``parts_for`` counts the buckets that many rows need.
    Months of loans that had to be range-split keep their slices and are stored
    without buckets, so that no bucket holds a whole hot loan.
    """
    spark = months.sparkSession
    name = f"loan_months_{uuid.uuid4().hex}"
    if SLICE in months.columns:
        months.write.option("path", path).saveAsTable(name)
        return name
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        months.repartition(buckets, *LOAN)
        .write.bucketBy(buckets, *LOAN).sortBy(*LOAN, "period")
        .option("path", path).saveAsTable(name)
    )
    return name


@lru_cache(maxsize=8)
def _months_table(spark: SparkSession, folder: str) -> str:
    # At most one month per line.
    buckets = parts_for(table(spark, folder, "lineitem"))
    return store_months(loan_months(spark, folder), fresh_path(spark, "loan-months"), buckets)


def months_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.table(_months_table(spark, folder))


@lru_cache(maxsize=8)
def panel_path(spark: SparkSession, folder: str) -> str:
    path = fresh_path(spark, "panel")
    panel = build_panel(months_of(spark, folder), loan_book(spark, folder), DRIVER_SETTINGS)
    panel_store.write_panel(panel, path)
    return path


def panel_of(spark: SparkSession, folder: str) -> DataFrame:
    return panel_store.read_panel(spark, panel_path(spark, folder))
