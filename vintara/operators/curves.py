"""Cohort hazard, survival and cumulative-incidence curves.

One aggregate reduces the panel to (cohorts x ages) rows; all curve windows run
on that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.functions.scalars import ratio
from vintara.settings import Settings

MIN_CELL = 100


def risk_sets(panel: DataFrame) -> DataFrame:
    """At-risk and exit counts per cohort and age, with the cohort size.

    Each loan has exactly one row at its first observed age, which makes the
    distinct loan count a plain count.
    """
    quiet = ~F.col("exit_reason").isin("default", "prepaid", "administrative_censor")
    counts = (
        panel.withColumnRenamed("origination_vintage", "vintage")
        .groupBy("vintage", "loan_age")
        .agg(
            F.count(F.lit(1)).alias("at_risk"),
            F.count_if("default_event").alias("defaults"),
            F.count_if("prepayment_event").alias("prepayments"),
            F.count_if(F.col("is_exit_month") & quiet).alias("censored"),
            F.count_if(F.col("loan_age") == F.col("first_observed_age")).alias("_entering"),
        )
    )
    size = F.sum("_entering").over(Window.partitionBy("vintage"))
    return counts.withColumn("cohort_size", size).drop("_entering")


def cohort_curves(panel: DataFrame, settings: Settings) -> DataFrame:
    """The hazard and incidence table, one row per cohort and age."""
    by_age = Window.partitionBy("vintage").orderBy("loan_age")
    so_far = by_age.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hazard = {
        "hazard_default": ratio(F.col("defaults"), F.col("at_risk")),
        "hazard_prepay": ratio(F.col("prepayments"), F.col("at_risk")),
    }
    staying = 1.0 - F.col("hazard_default") - F.col("hazard_prepay")
    curves = risk_sets(panel).withColumns(hazard).withColumns(
        {
            "survival": F.product(staying).over(so_far),
            # Kaplan-Meier on default alone treats prepayment as censoring: biased upward.
            "km_default": 1.0 - F.product(1.0 - F.col("hazard_default")).over(so_far),
        }
    )
    curves = curves.withColumn(
        "survival_entering", F.coalesce(F.lag("survival").over(by_age), F.lit(1.0))
    )

    def incidence(cause: str) -> Column:
        return F.sum(F.col("survival_entering") * F.col(f"hazard_{cause}")).over(so_far)

    def share(count: str) -> Column:
        return ratio(F.sum(count).over(so_far), F.col("cohort_size"))

    left = F.col("defaults") + F.col("prepayments") + F.col("censored")
    return (
        curves.withColumns(
            {
                "cif_default": incidence("default"),
                "cif_prepay": incidence("prepay"),
                "naive_default": share("defaults"),
                "naive_prepay": share("prepayments"),
                "naive_censored": share("censored"),
                "not_yet_exited_share": 1.0
                - ratio(F.sum(left).over(so_far), F.col("cohort_size")),
            }
        )
        .where(F.col("loan_age") <= settings.horizon)
    )


def calendar_hazards(panel: DataFrame, settings: Settings, min_cell: int = MIN_CELL) -> DataFrame:
    """Default hazard per cohort and calendar month, thin cells left out."""
    return (
        panel.where(F.col("loan_age") <= settings.horizon)
        .groupBy(
            F.col("origination_vintage").alias("vintage"),
            F.trunc("period_date", "MM").alias("calendar_month"),
        )
        .agg(
            F.avg("loan_age").alias("mean_loan_age"),
            F.count(F.lit(1)).alias("at_risk"),
            F.count_if("default_event").alias("defaults"),
        )
        .where(F.col("at_risk") >= min_cell)
        .withColumn("hazard_default", ratio(F.col("defaults"), F.col("at_risk")))
    )


def without_last_month(calendar: DataFrame) -> DataFrame:
    """Drop each cohort's final month, which holds only the tail of its reporting."""
    latest = F.max("calendar_month").over(Window.partitionBy("vintage"))
    return calendar.withColumn("_latest", latest).where("calendar_month < _latest").drop("_latest")


def split_label(cohort: Column, settings: Settings) -> Column:
    return F.when(cohort.isin(*settings.train_cohorts), "train").when(
        cohort.isin(*settings.test_cohorts), "test"
    )


def horizon_summary(curves: DataFrame, settings: Settings) -> DataFrame:
    """Each cohort's last age, its split and the checks on its incidence."""
    last = F.max("loan_age").over(Window.partitionBy("vintage"))
    return (
        curves.withColumn("_last", last)
        .where("loan_age = _last")
        .drop("_last")
        .withColumns(
            {
                "split": split_label(F.col("vintage"), settings),
                "km_overstatement": F.try_divide("km_default", "cif_default"),
                "km_at_least_cif": F.col("km_default") >= F.col("cif_default") - 1e-12,
                "naive_gap": F.abs(F.col("naive_default") - F.col("cif_default")),
            }
        )
    )


def smoothed(curves: DataFrame, column: str, width: int = 3) -> DataFrame:
    """Centred rolling mean over ages, shorter at the ends."""
    reach = width // 2
    around = Window.partitionBy("vintage").orderBy("loan_age").rowsBetween(-reach, reach)
    return curves.withColumn(f"{column}_smooth", F.avg(column).over(around))
