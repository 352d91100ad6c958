"""Value of the cash a loan actually produced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.functions.cashflow import discount_factor, monthly_discount
from vintara.operators.ordering import Timeline
from vintara.operators.rates import with_discount_rate
from vintara.settings import Settings

LOAN = ("origination_vintage", "loan_identifier")


class MissingOrigination(ValueError):
    """Valued loans have no origination record."""


def month_steps(performance: DataFrame) -> DataFrame:
    """Month index, first observed age, next and first balance over the full history.

    Sequenced before anything is filtered: a filter first would renumber months.
    """
    return (
        Timeline.of(performance, LOAN, ("period",))
        .running_sum(_position=F.lit(1).cast("long"))
        .lead(next_upb="current_actual_upb")
        .first(advanced_upb="current_actual_upb")
        .whole(first_observed_age=F.min("loan_age"), _months=F.count(F.lit(1)))
        .rows.withColumn("month_index", F.col("_position") - 1)
        .drop("_position")
    )


def valued_months(steps: DataFrame, settings: Settings) -> DataFrame:
    """Months inside the horizon of loans seen from origination."""
    last = F.least(F.col("_months"), F.lit(settings.horizon)) - 1
    return steps.where(
        (F.col("first_observed_age") == 0) & (F.col("month_index") < settings.horizon)
    ).withColumn("last_index", last)


def monthly_flows(months: DataFrame, rates: DataFrame, settings: Settings) -> DataFrame:
    """Interest, principal, servicing and loss per month, with the discount factor."""
    upb = F.col("current_actual_upb")
    step = F.coalesce(upb - F.col("next_upb"), F.lit(0.0))
    # Inner on cohort: months of cohorts without a rate are not valued.
    priced = with_discount_rate(months, rates).where(F.col("discount_rate").isNotNull())
    return priced.select(
        *LOAN, "month_index", "last_index", "advanced_upb", "next_upb", upb.alias("upb"),
        discount_factor(
            monthly_discount(F.col("discount_rate")), F.col("month_index") + 1
        ).alias("discount"),
        (upb * (F.col("current_interest_rate") / 100.0 / 12.0)).alias("interest"),
        step.alias("principal"),
        (upb * settings.servicing_bps / 10_000.0 / 12.0).alias("servicing"),
        F.coalesce("actual_loss", F.lit(0.0)).alias("loss"),
    )


def realised_legs(flows: DataFrame) -> DataFrame:
    """Present value of each leg per loan, in the partitioning of the months."""
    discount = F.col("discount")
    last = F.col("month_index") == F.col("last_index")
    closing = F.coalesce("next_upb", "upb")
    return flows.groupBy(*LOAN).agg(
        F.count(F.lit(1)).alias("months_valued"),
        F.sum(F.col("interest") * discount).alias("pv_interest"),
        F.sum(F.col("principal") * discount).alias("pv_principal"),
        (-F.sum(F.col("loss") * discount)).alias("pv_loss"),
        (-F.sum(F.col("servicing") * discount)).alias("pv_servicing"),
        F.sum(F.when(last, closing * discount).otherwise(0.0)).alias("pv_terminal"),
        F.max(F.when(last, closing).otherwise(0.0)).alias("terminal_balance"),
        F.sum("loss").alias("realised_loss"),
        F.max("month_index").alias("last_month_index"),
        F.max("advanced_upb").alias("advanced_upb"),
        F.sum("principal").alias("principal_undiscounted"),
    )


def legs_of(performance: DataFrame, rates: DataFrame, settings: Settings) -> DataFrame:
    months = valued_months(month_steps(performance), settings)
    return realised_legs(monthly_flows(months, rates, settings))


def realised_npv(legs: DataFrame, origination: DataFrame) -> DataFrame:
    """Realised NPV against the cash advanced; never-funded loans stay flagged.

    ``funded`` is false for loans that never report a positive balance, and
    ``principal`` is null for loans without an origination record.
    """
    terms = origination.select(*LOAN, F.col("original_upb").alias("principal"))
    received = (
        F.col("pv_interest") + F.col("pv_principal") + F.col("pv_terminal")
        + F.col("pv_loss") + F.col("pv_servicing")
    )
    return legs.join(terms, list(LOAN), "left").withColumns(
        {
            "funded": F.col("advanced_upb") > 0.0,
            "npv": received - F.col("advanced_upb"),
            "rounding_gap": F.col("advanced_upb") - F.col("principal"),
        }
    ).withColumn("npv_per_dollar", F.try_divide("npv", "advanced_upb"))


def funded_only(valued: DataFrame) -> DataFrame:
    return valued.where("funded").drop("funded")


def measure(
    performance: DataFrame, origination: DataFrame, rates: DataFrame, settings: Settings
) -> DataFrame:
    """Realised NPV of every funded loan."""
    return funded_only(realised_npv(legs_of(performance, rates, settings), origination))


def require_origination(valued: DataFrame) -> None:
    missing = valued.where(F.col("principal").isNull()).count()
    if missing:
        raise MissingOrigination(f"{missing} valued loans have no origination record")


def portfolio_legs(valued: DataFrame) -> DataFrame:
    """Portfolio totals of the legs, with loss and survival shares and the unfunded count."""
    funded = F.col("funded")

    def total(column: str):
        return F.sum(F.when(funded, F.col(column)))

    legs = ("pv_interest", "pv_principal", "pv_terminal", "pv_loss", "pv_servicing", "npv")
    return valued.agg(
        F.count_if(funded).alias("loans"),
        F.count_if(~funded).alias("unfunded"),
        total("advanced_upb").alias("advanced"),
        *[total(c).alias(f"{c}_total") for c in legs],
        F.avg(F.when(funded, F.col("npv"))).alias("npv_per_loan"),
        F.avg(F.when(funded, (F.col("realised_loss") > 0).cast("int"))).alias("loss_share"),
        F.avg(F.when(funded, (F.col("terminal_balance") > 0).cast("int"))).alias("alive_share"),
    )


def loss_censoring(steps: DataFrame, settings: Settings) -> DataFrame:
    """Priced losses inside and outside the horizon, for loans seen from origination."""
    inside = F.col("month_index") < settings.horizon
    return steps.where(
        (F.col("first_observed_age") == 0) & F.col("actual_loss").isNotNull()
    ).agg(
        F.count(F.lit(1)).alias("priced_dispositions"),
        F.count_if(inside).alias("inside_horizon"),
        F.sum("actual_loss").alias("total_loss"),
        F.sum(F.when(inside, F.col("actual_loss"))).alias("loss_inside_horizon"),
    )


def telescoping_audit(legs: DataFrame) -> DataFrame:
    """Largest gap between cash advanced and principal returned plus terminal balance."""
    gap = F.abs(
        F.col("principal_undiscounted") + F.col("terminal_balance") - F.col("advanced_upb")
    )
    return legs.agg(F.count(F.lit(1)).alias("loans"), F.max(gap).alias("largest_gap"))
