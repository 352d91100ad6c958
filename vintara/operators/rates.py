"""Benchmark yields and the discount rate of each cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintara.settings import Settings

BPS = 10_000.0


class UncoveredCohorts(ValueError):
    """Some cohorts have no benchmark observation."""


def monthly_yields(daily: DataFrame) -> DataFrame:
    """Mean yield per month of a daily text series; a dot is no observation."""
    observed = F.expr("try_cast(value AS double)")
    return (
        daily.select(F.to_date("observation_date").alias("day"), observed.alias("yield_pct"))
        .where(F.col("yield_pct").isNotNull())
        .groupBy(F.trunc("day", "MM").alias("month"))
        .agg(F.avg("yield_pct").alias("yield_pct"))
        .withColumn("vintage", F.year("month"))
    )


def benchmark_by_cohort(monthly: DataFrame) -> DataFrame:
    """Mean of the monthly means per year, as a fraction."""
    return monthly.groupBy("vintage").agg((F.avg("yield_pct") / 100.0).alias("benchmark_rate"))


def _configured(spark: SparkSession, settings: Settings) -> DataFrame:
    values = ", ".join(f"({int(c)})" for c in settings.cohorts)
    return spark.sql(f"SELECT vintage FROM VALUES {values} AS cohorts(vintage)")


def uncovered_cohorts(benchmark: DataFrame, settings: Settings) -> DataFrame:
    return _configured(benchmark.sparkSession, settings).join(benchmark, "vintage", "left_anti")


def discount_rates(benchmark: DataFrame, settings: Settings) -> DataFrame:
    """Annual discount rate for each configured cohort.

    Holds at most one row per configured cohort, so joining it by broadcast is safe
    for any amount of data.
    """
    wanted = _configured(benchmark.sparkSession, settings)
    if settings.rate_mode == "fixed":
        return wanted.withColumn("discount_rate", F.lit(settings.fixed_rate))
    return wanted.join(F.broadcast(benchmark.where(F.col("vintage").isin(*settings.cohorts))), "vintage").select(
        "vintage", (F.col("benchmark_rate") + settings.spread_bps / BPS).alias("discount_rate")
    )


def require_covered(benchmark: DataFrame, settings: Settings) -> None:
    if settings.rate_mode == "fixed":
        return
    missing = sorted(r["vintage"] for r in uncovered_cohorts(benchmark, settings).collect())
    if missing:
        raise UncoveredCohorts(f"benchmark does not cover cohorts {missing}")


def require_rates(rates: DataFrame, settings: Settings) -> None:
    """Refuse rates that leave a configured cohort out: its loans would vanish from every value."""
    known = rates.where(F.col("discount_rate").isNotNull())
    missing = sorted(r["vintage"] for r in uncovered_cohorts(known, settings).collect())
    if missing:
        raise UncoveredCohorts(f"no discount rate for cohorts {missing}")


def with_discount_rate(loans: DataFrame, rates: DataFrame) -> DataFrame:
    by_cohort = rates.withColumnRenamed("vintage", "origination_vintage")
    return loans.join(F.broadcast(by_cohort), "origination_vintage", "left")


def note_rates(origination: DataFrame) -> DataFrame:
    return origination.groupBy(F.col("origination_vintage").alias("vintage")).agg(
        (F.avg("original_interest_rate") / 100.0).alias("note_rate")
    )


def primary_spread(origination: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Note rate minus benchmark: the ceiling of a defensible discount spread."""
    return note_rates(origination).join(benchmark, "vintage").withColumn(
        "spread_bps", (F.col("note_rate") - F.col("benchmark_rate")) * BPS
    )


def bracket_check(origination: DataFrame, benchmark: DataFrame, settings: Settings) -> DataFrame:
    """Does each discount rate lie strictly between benchmark and note rate?"""
    rate, note = F.col("discount_rate"), F.col("note_rate")
    return (
        primary_spread(origination, benchmark)
        .join(discount_rates(benchmark, settings), "vintage")
        .withColumns(
            {
                "inside_bracket": (rate > F.col("benchmark_rate")) & (rate < note),
                "headroom_bps": (note - rate) * BPS,
            }
        )
    )
