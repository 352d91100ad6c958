"""Projecting loans from origination and pricing the projected book.

Loan values fold over a loan's months inside its row. Month rows exist only where they are the result, and where the book is
summed by month: those sums price every scope and economics cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.functions.cashflow import (
    discount_factor, monthly_discount, monthly_payment, recovery_multiple, scheduled_balance,
)
from vintara.functions.scalars import defaulted_by, in_share, resolved_by
from vintara.operators.fold import Hazards, calibrated, loan_lives, months_of, path
from vintara.operators.hazard import LOAN
from vintara.operators.rates import with_discount_rate
from vintara.operators.recalibration import Calibrator
from vintara.operators.valuation import LEGS, TERMS
from vintara.settings import Settings

SCOPES = ("headline", "sequential", "sensitivity")
KEPT = ("exit_age", "exit_reason", *TERMS)


class UnmatchedLoans(ValueError):
    """Loans without a projected incidence."""


def loan_terms(panel: DataFrame, rates: DataFrame) -> DataFrame:
    """One row per loan at its first at-risk month, with its cohort's discount rate."""
    first = panel.where(F.col("loan_age") == F.col("first_observed_age"))
    return with_discount_rate(first, rates)


def from_origination(loans: DataFrame) -> DataFrame:
    """Loans with a decision point on record."""
    return loans.where(F.col("first_observed_age") == 0)


def with_months(loans: DataFrame, hazards: Hazards, settings: Settings) -> DataFrame:
    """Slim loan rows with the hazards of their months in one array, ``_months``."""
    kept = [*LOAN, *[c for c in KEPT if c in loans.columns]]
    rows = loans.withColumns(hazards.inputs) if hazards.inputs else loans
    return rows.withColumn("_months", months_of(hazards, settings)).select(*kept, "_months")


def projected_paths(
    loans: DataFrame, hazards: Hazards, settings: Settings, calibrator: Calibrator | None = None
) -> DataFrame:
    """Paths with survival and incidence; a calibrator changes the default hazard only,
    before survival, so it also moves the weight of every later month."""
    rows = with_months(loans, hazards, settings)
    kept = [c for c in rows.columns if c != "_months"]
    return rows.select(*kept, F.inline(path(calibrated(F.col("_months"), calibrator))))


def cumulative_calibration(paths: DataFrame, settings: Settings, population: str) -> DataFrame:
    """Predicted and observed cumulative incidence at each horizon.

    Loans censored before a horizon are left out of it. The outcome travels on the
    path rows, so predicted and observed sides cannot drift apart and no join is needed.
    """
    months = F.col("loan_age") + 1
    resolved, defaulted = resolved_by(months), defaulted_by(months)
    table = (
        paths.where(months.isin(*settings.horizons))
        .groupBy(months.alias("horizon_months"))
        .agg(
            F.count_if(resolved).alias("loans"),
            F.count_if(~resolved).alias("excluded_censored"),
            F.avg(F.when(resolved, defaulted.cast("double"))).alias("observed_rate"),
            F.avg(F.when(resolved, F.col("cif_default"))).alias("predicted_rate"),
            F.count_if(resolved & F.col("cif_default").isNull()).alias("unmatched"),
        )
    )
    return table.withColumns(
        {
            "population": F.lit(population),
            "ratio": F.try_divide("predicted_rate", F.nullif(F.col("observed_rate"), F.lit(0.0))),
            "gap": F.col("predicted_rate") - F.col("observed_rate"),
        }
    )


def require_matched(table: DataFrame) -> None:
    missing = table.agg(F.sum("unmatched")).first()[0]
    if missing:
        raise UnmatchedLoans(f"{missing} loans have no projected incidence")


def variant_paths(
    loans: DataFrame, hazards: Hazards, variants: dict[str, Calibrator | None], settings: Settings
) -> DataFrame:
    """Paths of every hazard variant, labelled. Months are scored once per loan."""
    rows = with_months(loans, hazards, settings)
    kept = [c for c in rows.columns if c != "_months"]
    labelled = F.array(
        *[
            F.struct(F.lit(name).alias("variant"), calibrated(F.col("_months"), calibrator).alias("_months"))
            for name, calibrator in variants.items()
        ]
    )
    split = rows.select(*kept, F.inline(labelled))
    return split.select(*kept, "variant", F.inline(path(F.col("_months"))))


def economics_cells(settings: Settings) -> list[tuple[float, float]]:
    return [(g, s) for g in settings.sensitivity_lgds for s in settings.sensitivity_spreads]


def _cell_array(scope: str, grid: list[tuple[float, float]]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(scope).alias("scope"), F.lit(float(g)).alias("lgd"),
                F.lit(float(s)).alias("discount_spread_bps"),
            )
            for g, s in grid
        ]
    )


def scope_cells(settings: Settings) -> Column:
    """The (scope, severity, spread) cells a row of the portfolio sums takes part in.

    headline: every loan, all variants but the sequential one, at the configured
    economics. sequential: later test cohorts, all variants. sensitivity: the hash
    sample of those, over the economics grid.
    """
    configured = [(settings.lgd, settings.spread_bps)]
    later, sampled = F.col("later"), F.col("sampled")

    def only(condition: Column, cells: Column) -> Column:
        return F.when(condition, cells).otherwise(F.slice(cells, 1, 0))

    return F.concat(
        only(F.col("variant") != "sequential", _cell_array("headline", configured)),
        only(later, _cell_array("sequential", configured)),
        only(later & sampled, _cell_array("sensitivity", economics_cells(settings))),
    )


def portfolio_sums(paths: DataFrame, settings: Settings) -> DataFrame:
    """Undiscounted cash of the book per variant, discount rate, scope membership and month.

    Value is linear in severity, and the discount depends on the rate, the spread and the month alone, so
    these sums price every cell. Rates belong to cohorts: the table has a few rows per cohort and month, combined within tasks.
    """
    upb, term, age = F.col("original_upb"), F.col("original_loan_term"), F.col("loan_age")
    note = F.col("original_interest_rate") / 100.0
    default, prepaid, entering = F.col("hazard_default"), F.col("hazard_prepayment"), F.col("survival_entering")
    stays, balance = 1.0 - (default + prepaid), scheduled_balance(upb, note, term, age)
    sampled = in_share(F.col("loan_identifier"), settings.sensitivity_share, settings.holdout_seed)
    last = age == settings.horizon - 1
    return paths.groupBy(
        "variant", "discount_rate", F.col("origination_vintage").isin(*settings.test_cohorts[1:]).alias("later"),
        sampled.alias("sampled"), "loan_age",
    ).agg(
        F.count(F.lit(1)).alias("loans"), F.sum(upb).alias("principal"),
        F.count_if(default + prepaid >= 1.0).alias("overflows"),
        F.sum(entering * stays * monthly_payment(upb, note, term)).alias("paid"),
        F.sum(entering * prepaid * balance).alias("prepaid"), F.sum(entering * default * balance).alias("defaulted"),
        F.sum(entering * balance).alias("serviced"),
        F.sum(F.when(last, entering * stays * scheduled_balance(upb, note, term, age + 1))).alias("owed"),
    )


def portfolio_npv(sums: DataFrame, settings: Settings, cells: Column | None = None) -> DataFrame:
    """Portfolio value per variant, scope and economics cell, with the change against raw.

    All from the portfolio sums; no month row of a loan is repeated per cell. ``overflows`` counts months of loans whose
    hazards reach one: where it is not zero, the value of that row does not hold.
    """
    literal = _cell_array("headline", [(settings.lgd, settings.spread_bps)]) if cells is None else cells
    shifted = F.col("discount_rate") + (F.col("discount_spread_bps") - settings.spread_bps) / 10_000.0
    monthly = monthly_discount(shifted)
    arrives = discount_factor(monthly, F.col("loan_age") + 1)
    recovery = recovery_multiple(monthly, F.col("lgd"), settings.loss_probability, settings.recovery_lag)
    first = F.col("loan_age") == 0
    total = {
        "interest_leg": arrives * F.col("paid"), "prepayment_leg": arrives * F.col("prepaid"),
        "default_leg": arrives * recovery * F.col("defaulted"), "terminal_leg": arrives * F.col("owed"),
        "servicing_leg": -arrives * (settings.servicing_bps / 10_000.0 / 12.0) * F.col("serviced"),
        "principal": F.when(first, F.col("principal")), "loans": F.when(first, F.col("loans")),
        "overflows": F.col("overflows"),
    }
    cell = ["scope", "lgd", "discount_spread_bps"]
    rows = sums.select("*", F.inline(literal))
    sums = rows.groupBy("variant", *cell).agg(*[F.sum(c).alias(n) for n, c in total.items()])
    npv = -F.col("principal")
    for leg in LEGS:
        npv = npv + F.col(leg)
    table = sums.withColumn("npv_total", npv).withColumns(
        {
            "npv_per_loan": F.try_divide("npv_total", "loans"),
            "npv_per_dollar": F.try_divide("npv_total", "principal"),
        }
    )
    # Variants x cells rows: the raw value of a cell is read from its own rows.
    is_raw = F.col("variant") == "raw"
    raw = F.max(F.when(is_raw, F.col("npv_per_loan"))).over(Window.partitionBy(*cell))
    return table.withColumn("_raw", raw).withColumns(
        {
            "delta_vs_raw": F.col("npv_per_loan") - F.col("_raw"),
            "delta_pct": F.try_divide(F.col("npv_per_loan") - F.col("_raw"), F.abs("_raw")),
        }
    ).drop("_raw")


def sensitivity_sample(loans: DataFrame, settings: Settings) -> DataFrame:
    """The keyed hash sample the economics grid is evaluated on."""
    keep = in_share(F.col("loan_identifier"), settings.sensitivity_share, settings.holdout_seed)
    return loans.where(keep)


def sensitivity_band(grid: DataFrame) -> DataFrame:
    """Smallest, middle and largest change per variant and severity over the spreads."""
    return grid.where("variant <> 'raw' AND scope = 'sensitivity'").groupBy("variant", "lgd").agg(
        F.min("delta_vs_raw").alias("low"),
        F.median("delta_vs_raw").alias("middle"),
        F.max("delta_vs_raw").alias("high"),
    )


def loan_values(
    loans: DataFrame, hazards: Hazards, settings: Settings, calibrator: Calibrator | None = None, **overrides
) -> DataFrame:
    """Window score, legs and NPV per loan, folded inside its row; loans are neither exploded nor exchanged."""
    return loan_lives(loans, {"_value": (hazards, calibrator)}, settings, **overrides).select(*LOAN, "_value.*")


def arm_values(
    loans: DataFrame, arms: dict[str, tuple[Hazards, Calibrator | None]], settings: Settings
) -> DataFrame:
    """The loans with ``score_<arm>`` and ``expected_<arm>`` of every arm, in one pass."""
    lives = loan_lives(loans, arms, settings)
    named = [F.col(f"{a}.{of}").alias(f"{name}_{a}") for a in arms for name, of in (("score", "score"), ("expected", "npv"))]
    over = [F.col(f"{a}.overflows") for a in arms]
    return lives.select(*loans.columns, *named, sum(over[1:], over[0]).alias("overflows"))


def value_faults(*values: str) -> dict[str, Column]:
    """Counts of values that do not hold: of loans that lack one, and of months whose hazards reach one."""
    lacking = F.lit(False)
    for value in values:
        lacking = lacking | F.col(value).isNull()
    return {"unpriced": F.count_if(lacking), "overflows": F.coalesce(F.sum("overflows"), F.lit(0))}
