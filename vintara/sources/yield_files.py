"""Reading a benchmark yield series from a two-column CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vintara.operators.rates import monthly_yields


class WrongSeries(ValueError):
    """The file holds another series than the settings ask for."""


class EmptySeries(ValueError):
    """The file holds dates but no observation."""


def load_yields(spark: SparkSession, path: str, series: str | None = None) -> DataFrame:
    """Monthly means of a daily series; the header must name the expected series."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if len(raw.columns) != 2:
        raise WrongSeries(f"{path}: expected 2 columns, found {len(raw.columns)}")
    found = raw.columns[1].strip()
    if series is not None and found != series:
        raise WrongSeries(f"{path} holds series {found!r}, settings ask for {series!r}")
    monthly = monthly_yields(raw.toDF("observation_date", "value"))
    if monthly.isEmpty():
        raise EmptySeries(f"{path} holds no observation of {found!r}")
    return monthly
