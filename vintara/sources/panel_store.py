"""The stored panel and small report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintara.sources.loan_schema import COHORT


def write_panel(panel: DataFrame, path: str) -> None:
    """Parquet, one folder per cohort, so cohort filters prune files."""
    panel.write.mode("overwrite").partitionBy(COHORT).parquet(path)


def read_panel(
    spark: SparkSession, path: str, cohorts: Sequence[int] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Only the wanted cohorts' files and the wanted columns."""
    panel = spark.read.parquet(path)
    if cohorts is not None:
        panel = panel.where(F.col(COHORT).isin(*cohorts))
    return panel.select(*columns) if columns else panel


def write_report(table: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """A small result table as one CSV file with a header."""
    ordered = table.orderBy(*order) if order else table
    ordered.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
