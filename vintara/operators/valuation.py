"""Expected value of projected loan paths as discounted cash-flow legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.functions.cashflow import (
    discount_factor, monthly_discount, monthly_payment, recovery_multiple, scheduled_balance,
)
from vintara.settings import Settings, SettingsError

TERMS = ["original_upb", "original_interest_rate", "original_loan_term", "discount_rate"]
PATH = ["loan_age", "hazard_default", "hazard_prepayment", "survival_entering"]
LEGS = ["interest_leg", "prepayment_leg", "default_leg", "terminal_leg", "servicing_leg"]
DRIFT = 1e-9


class PathError(ValueError):
    """Projected paths and loan terms do not fit together."""


def path_audit(
    paths: DataFrame, terms: DataFrame, keys: tuple[str, ...] = ("loan_identifier",)
) -> DataFrame:
    """(check, value) rows: counts that must be zero, and the largest survival drift."""
    walk = Window.partitionBy(*keys).orderBy("loan_age")
    stays = 1.0 - F.col("hazard_default") - F.col("hazard_prepayment")
    # One ordered pass covers the first row, the recursion and repeated ages.
    stepped = paths.select(
        "loan_age", "survival_entering",
        F.lag("loan_age").over(walk).alias("_age"),
        F.lag(F.col("survival_entering") * stays).over(walk).alias("_expected"),
    )
    opening = F.col("_age").isNull()
    drift = F.abs(F.col("survival_entering") - F.col("_expected"))
    walked = stepped.agg(
        F.count_if(opening & (F.abs(F.col("survival_entering") - 1.0) > 1e-8)).alias("bad_starts"),
        F.coalesce(F.max(F.when(~opening, drift)), F.lit(0.0)).alias("max_drift"),
        F.count_if(F.col("loan_age") <= F.col("_age")).alias("repeated_ages"),
    )
    known = terms.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    repeated = known.agg(F.count_if(F.col("_n") > 1).alias("repeated_terms"))
    orphans = paths.join(known, list(keys), "left_anti").agg(F.count(F.lit(1)).alias("orphan_rows"))

    def checks(row: DataFrame) -> DataFrame:
        pairs = [
            F.struct(F.lit(c).alias("check"), F.col(c).cast("double").alias("value"))
            for c in row.columns
        ]
        return row.select(F.inline(F.array(*pairs)))

    return checks(walked).unionByName(checks(repeated)).unionByName(checks(orphans))


def require_sound_paths(
    paths: DataFrame, terms: DataFrame, keys: tuple[str, ...] = ("loan_identifier",)
) -> None:
    found = {r["check"]: r["value"] for r in path_audit(paths, terms, keys).collect()}
    wrong = {c: v for c, v in found.items() if v > (DRIFT if c == "max_drift" else 0)}
    if wrong:
        raise PathError(f"paths refused: {wrong}")


def checked_lgd(settings: Settings, lgd: float | None, loss_probability: float) -> float:
    severity = settings.lgd if lgd is None else lgd
    if severity > loss_probability:
        raise SettingsError(f"lgd {severity} above loss probability {loss_probability}")
    return severity


def leg_amounts(
    alive: Column, default: Column, prepaid: Column, balance: Column, owed: Column, payment: Column, recovery: Column,
    servicing_bps: float,
) -> dict[str, Column]:
    """Leg contributions of one month; ``alive`` is its entering survival, discounted to the loan's start.

    Cash of month ``t`` arrives at ``t + 1``; ``ending_balance`` is what the loan is
    expected to owe then, booked as the terminal leg in its last month.
    """
    stays = 1.0 - (default + prepaid)
    return {
        "interest_leg": alive * stays * payment,
        "prepayment_leg": alive * prepaid * balance,
        "default_leg": alive * default * balance * recovery,
        "servicing_leg": -alive * (servicing_bps / 10_000.0 / 12.0) * balance,
        "ending_balance": alive * stays * owed,
    }


def monthly_legs(
    settings: Settings,
    *,
    lgd: float | None = None,
    loss_probability: float | None = None,
    recovery_lag: int | None = None,
    servicing_bps: float | None = None,
) -> dict[str, Column]:
    """Discounted leg contributions of one path row."""
    q = settings.loss_probability if loss_probability is None else loss_probability
    lag = settings.recovery_lag if recovery_lag is None else recovery_lag
    bps = settings.servicing_bps if servicing_bps is None else servicing_bps
    upb, term, age = F.col("original_upb"), F.col("original_loan_term"), F.col("loan_age")
    note = F.col("original_interest_rate") / 100.0
    monthly = monthly_discount(F.col("discount_rate"))
    return leg_amounts(
        F.col("survival_entering") * discount_factor(monthly, age + 1), F.col("hazard_default"),
        F.col("hazard_prepayment"), scheduled_balance(upb, note, term, age), scheduled_balance(upb, note, term, age + 1),
        monthly_payment(upb, note, term), recovery_multiple(monthly, checked_lgd(settings, lgd, q), q, lag), bps,
    )


def price_paths(paths: DataFrame, settings: Settings, keys: list[str], **overrides) -> DataFrame:
    """NPV legs per key from path rows that already carry the loan terms.

    ``keys`` starts with the columns the paths are partitioned by, so the grouping
    needs no shuffle of the month rows.
    """
    months = paths.withColumns(monthly_legs(settings, **overrides))
    value = months.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in LEGS if c != "terminal_leg"],
        F.max_by("ending_balance", "loan_age").alias("terminal_leg"),
        F.first("original_upb", True).alias("principal"),
    )
    return with_npv(value)


def with_npv(value: DataFrame) -> DataFrame:
    total = -F.col("principal")
    for leg in LEGS:
        total = total + F.col(leg)
    return value.withColumn("npv", total).withColumn(
        "npv_per_dollar", F.try_divide("npv", "principal")
    )


def loan_npv(paths: DataFrame, terms: DataFrame, settings: Settings, **overrides) -> DataFrame:
    """NPV per loan for paths and terms that come as two tables."""
    joined = paths.select("loan_identifier", *PATH).join(
        terms.select("loan_identifier", *TERMS), "loan_identifier"
    )
    return price_paths(joined, settings, ["loan_identifier"], **overrides)


def portfolio_decomposition(values: DataFrame) -> DataFrame:
    """Each leg's total and its share of principal."""
    totals = values.agg(
        F.count(F.lit(1)).alias("loans"), F.sum("principal").alias("principal"),
        *[F.sum(c).alias(c) for c in (*LEGS, "npv")],
    )
    return totals.withColumns(
        {f"{c}_share": F.try_divide(c, "principal") for c in (*LEGS, "npv")}
    ).withColumn("npv_per_loan", F.try_divide("npv", "loans"))
