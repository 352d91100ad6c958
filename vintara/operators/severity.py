"""Loss severity, measured from priced dispositions of defaulted loans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintara.functions.cashflow import (
    discount_factor, monthly_discount, monthly_payment, scheduled_balance,
)
from vintara.functions.scalars import ratio
from vintara.operators.curves import split_label
from vintara.operators.quantiles import exact_quantiles
from vintara.operators.rates import with_discount_rate
from vintara.settings import Settings
from vintara.storage import durable

LOAN = ["origination_vintage", "loan_identifier"]


def _positive(balance: str) -> Column:
    return F.nullif(F.col(balance), F.lit(0.0))


def priced_losses(performance: DataFrame, settings: Settings) -> DataFrame:
    return performance.where(
        F.col("zero_balance_code").isin(*settings.severity_codes) & F.col("actual_loss").isNotNull()
    )


def default_outcomes(panel: DataFrame, performance: DataFrame, settings: Settings) -> DataFrame:
    """Each loan that reached default with its priced losses, if any.

    The event flag is set on one row per loan, so no grouping is needed.
    """
    reached = panel.where("default_event").select(
        *LOAN, _positive("current_actual_upb").alias("exposure_at_default")
    )
    losses = priced_losses(performance, settings).select(
        *LOAN, "actual_loss", _positive("zero_balance_removal_upb").alias("exposure_at_disposition")
    )
    return reached.join(losses, LOAN, "left")


def severity(outcomes: DataFrame, settings: Settings) -> DataFrame:
    """Frequency and severity by cohort, by split and overall, in one pass."""
    cohort = F.col("origination_vintage")
    scopes = F.array(
        F.struct(F.lit("cohort").alias("scope"), cohort.cast("string").alias("label")),
        F.struct(F.lit("split").alias("scope"), split_label(cohort, settings).alias("label")),
        F.struct(F.lit("all").alias("scope"), F.lit("all").alias("label")),
    )
    # Defaults only, read by the sums and by the quantiles: kept once.
    rows = durable(outcomes).select("*", F.inline(scopes)).where(F.col("label").isNotNull())
    loss, booked = F.col("actual_loss"), F.col("exposure_at_default")
    disposed = F.col("exposure_at_disposition")
    priced = loss.isNotNull()
    parts = {
        "reached_default": F.count(F.lit(1)),
        "reached_loss_disposition": F.count(loss),
        "usable_for_severity": F.count_if(priced & booked.isNotNull()),
        "probability_of_loss": ratio(F.count(loss), F.count(F.lit(1))),
        "total_loss": F.sum(loss),
        "total_exposure_at_default": F.sum(F.when(priced, booked)),
        "lgd_at_default_balance": F.try_divide(
            F.sum(F.when(booked.isNotNull(), loss)), F.sum(F.when(priced, booked))
        ),
        "lgd_at_disposition": F.try_divide(
            F.sum(F.when(disposed.isNotNull(), loss)), F.sum(F.when(priced, disposed))
        ),
    }
    table = rows.groupBy("scope", "label").agg(*[c.alias(n) for n, c in parts.items()])
    shares = rows.select("scope", "label", F.try_divide(loss, disposed).alias("share"))
    spread = exact_quantiles(shares, ["scope", "label"], "share", [0.5, 0.1, 0.9]).select(
        "scope", "label",
        F.get("quantiles", F.lit(0)).alias("lgd_median"),
        F.get("quantiles", F.lit(1)).alias("lgd_p10"),
        F.get("quantiles", F.lit(2)).alias("lgd_p90"),
    )
    return table.join(spread, ["scope", "label"], "left").withColumns(
        {
            "effective_lgd": F.col("probability_of_loss") * F.col("lgd_at_default_balance"),
            "cure_rate": 1.0 - F.col("probability_of_loss"),
        }
    )


def degradation(table: DataFrame) -> DataFrame:
    """Train to test ratios of frequency, severity and their product."""
    splits = table.where("scope = 'split'")

    def of(column: str, split: str) -> Column:
        return F.max(F.when(F.col("label") == split, F.col(column)))

    def change(column: str) -> Column:
        return F.try_divide(of(column, "test"), of(column, "train"))

    return splits.agg(
        change("probability_of_loss").alias("frequency_ratio"),
        change("lgd_at_default_balance").alias("severity_ratio"),
        change("effective_lgd").alias("effective_ratio"),
    )


def defaulted_loans(panel: DataFrame, performance: DataFrame, settings: Settings) -> DataFrame:
    """Defaulted loans with the terms in force and whether a loss was priced."""
    lost = priced_losses(performance, settings).select(*LOAN).distinct()
    return (
        panel.where("default_event")
        .select(
            *LOAN, F.col("loan_age").alias("default_age"), "original_upb",
            "original_interest_rate", "original_loan_term",
        )
        .join(lost.withColumn("had_loss_disposition", F.lit(True)), LOAN, "left")
        .withColumn("had_loss_disposition", F.coalesce("had_loss_disposition", F.lit(False)))
    )


def cure_costs(defaulted: DataFrame, rates: DataFrame, settings: Settings) -> DataFrame:
    """Value given up per cured loan by booking its balance at default.

    ``cost`` is null for loans whose loss was priced. The remaining payments are a level annuity, so their value has a closed form
    and no month rows are generated.
    """
    loans = with_discount_rate(defaulted, rates)
    cured = ~F.col("had_loss_disposition")
    upb, term, age = F.col("original_upb"), F.col("original_loan_term"), F.col("default_age")
    note = F.col("original_interest_rate") / 100.0
    monthly = monthly_discount(F.col("discount_rate"))
    end = F.lit(settings.horizon)
    left = end - age
    annuity = discount_factor(monthly, age) * F.when(
        F.abs(monthly) < 1e-12, left.cast("double")
    ).otherwise(F.try_divide(1.0 - discount_factor(monthly, left), monthly))
    continued = monthly_payment(upb, note, term) * annuity
    final = scheduled_balance(upb, note, term, end) * discount_factor(monthly, end)
    at_default = scheduled_balance(upb, note, term, age)
    booked = at_default * discount_factor(monthly, age + 1)
    return loans.select(
        *LOAN, "had_loss_disposition", F.when(cured, age).alias("default_age"),
        F.when(cured, continued + final - booked).alias("cost"),
        F.when(cured, at_default).alias("balance_at_default"),
    )


def cure_summary(costs: DataFrame) -> DataFrame:
    costs = durable(costs)
    middle = exact_quantiles(costs, [], "cost", [0.5]).first()
    median = middle["quantiles"][0] if middle else None
    table = costs.agg(
        F.count(F.lit(1)).alias("reached_default"),
        F.count_if("had_loss_disposition").alias("had_loss_disposition"),
        F.count("cost").alias("cured"),
        F.avg("cost").alias("mean_cost"),
        F.sum("cost").alias("total_cost"),
        F.avg("default_age").alias("mean_default_age"),
        F.avg("balance_at_default").alias("mean_balance_at_default"),
    )
    share = F.try_divide("mean_cost", F.nullif(F.col("mean_balance_at_default"), F.lit(0.0)))
    return table.withColumns(
        {
            "median_cost": F.lit(median).cast("double"),
            "cost_share_of_balance": F.coalesce(share, F.lit(0.0)),
        }
    )
