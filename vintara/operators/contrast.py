"""Side-by-side of two train/test arms from their small report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintara.operators.reliability import HOLDOUT, TEST, TRAIN


def _at(column: str, population: str, variant: str) -> Column:
    hit = (F.col("population") == population) & (F.col("variant") == variant)
    return F.max(F.when(hit, F.col(column)))


def arm_contrast(scores: DataFrame) -> DataFrame:
    """One row per arm of a score table with an ``arm`` label."""
    sequential = F.contains("population", F.lit("sequential"))
    raw = F.col("variant") == "raw"
    row = scores.groupBy("arm").agg(
        _at("base_rate", TRAIN, "raw").alias("train_base_rate"),
        _at("base_rate", TEST, "raw").alias("test_base_rate"),
        _at("marginal_ratio", TRAIN, "raw").alias("in_sample_ratio"),
        _at("marginal_ratio", HOLDOUT, "raw").alias("holdout_ratio"),
        _at("marginal_ratio", TEST, "raw").alias("test_ratio"),
        _at("ece", TEST, "raw").alias("_ece"),
        _at("marginal_ratio", TEST, "platt").alias("_platt"),
        F.max(F.when(sequential & raw, F.col("marginal_ratio"))).alias("_later_raw"),
        F.max(F.when(sequential & ~raw, F.col("marginal_ratio"))).alias("_later_fit"),
    )

    def closed(before: str, after: str) -> Column:
        gap = F.abs(F.col(before) - 1.0)
        return F.try_divide(gap - F.abs(F.col(after) - 1.0), gap)

    return row.withColumns(
        {
            "base_rate_shift": F.try_divide("test_base_rate", "train_base_rate"),
            "shortfall": 1.0 - F.col("test_ratio"),
            "ece_over_base_rate": F.try_divide("_ece", "test_base_rate"),
            "platt_closes": closed("test_ratio", "_platt"),
            "sequential_closes": closed("_later_raw", "_later_fit"),
        }
    ).drop("_ece", "_platt", "_later_raw", "_later_fit")


def horizon_contrast(horizons: DataFrame, months: tuple[int, ...]) -> DataFrame:
    """Cumulative ratio per arm, one column per horizon."""
    return horizons.groupBy("arm").agg(
        *[
            F.max(F.when(F.col("horizon_months") == m, F.col("ratio"))).alias(f"ratio_{m}m")
            for m in months
        ]
    )


def npv_contrast(npv: DataFrame) -> DataFrame:
    """Value per loan and per dollar moved by recalibration, per arm."""
    later = npv.where("scope = 'sequential'")

    def of(column: str, variant: str) -> Column:
        return F.max(F.when(F.col("variant") == variant, F.col(column)))

    points = lambda v: (of("npv_per_dollar", v) - of("npv_per_dollar", "raw")) * 100.0
    return later.groupBy("arm").agg(
        of("npv_per_loan", "raw").alias("npv_per_loan_raw"),
        of("npv_per_loan", "sequential").alias("npv_per_loan_sequential"),
        of("delta_vs_raw", "sequential").alias("effect_per_loan"),
        points("sequential").alias("effect_points"),
        points("platt").alias("platt_points"),
    )
