"""Registered rate, severity, realised and expected value queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from vintara.functions.cashflow import monthly_payment, scheduled_balance
from vintara.functions.scalars import sigmoid
from vintara.operators import fold, projection, rates, realised, severity, valuation
from vintara.operators.recalibration import Platt
from vintara.plans.queries.panel import rounded
from vintara.plans.stored import months_of, panel_of
from vintara.sources import yield_files
from vintara.sources.driver_tables import DRIVER_SETTINGS as S
from vintara.sources.driver_tables import daily_yields, loan_book
from vintara.storage import fresh_path

LEGS = valuation.LEGS


class RoundedPlatt(Platt):
    """A fixed recalibration, rounded so that SQL engines break ties alike."""

    def column(self, probability):
        return F.round(super().column(probability), 12)


FIXED_PLATT = RoundedPlatt(0.9, 0.2)


def fixed_hazards(age=None):
    """Hazards with fixed coefficients, so that plain SQL can reproduce them."""
    age = F.col("loan_age") if age is None else age
    fico = F.coalesce(F.col("classic_fico"), F.lit(700)) - 700
    cltv = F.col("original_combined_loan_to_value") - 70
    default = sigmoid(-2.6 + 0.15 * age - 0.008 * fico + 0.02 * cltv)
    prepaid = sigmoid(-2.2 + 0.1 * age + 0.3 * (F.col("original_interest_rate") - 6.0))
    return F.round(0.5 * default, 12), F.round(0.5 * prepaid, 12)


FIXED_HAZARDS = fold.Hazards(lambda age: fixed_hazards(age)[0], lambda age: fixed_hazards(age)[1])


def benchmark_of(spark, folder):
    return rates.benchmark_by_cohort(rates.monthly_yields(daily_yields(spark, folder)))


def rates_of(spark, folder):
    return rates.discount_rates(benchmark_of(spark, folder), S)


def monthly_yields(spark, folder):
    """The daily series, written as the two-column file it usually comes as and read from there."""
    path = fresh_path(spark, "yields")
    daily_yields(spark, folder).withColumnRenamed("value", "DGS30").write.option("header", True).csv(path)
    return rounded(yield_files.load_yields(spark, path, "DGS30"), 9, "yield_pct")


def discount_rates(spark, folder):
    benchmark = benchmark_of(spark, folder)
    tracked = rates.discount_rates(benchmark, S).withColumn("mode", F.lit("treasury_plus_spread"))
    fixed = rates.discount_rates(benchmark, replace(S, rate_mode="fixed"))
    return rounded(tracked, 9, "discount_rate").unionByName(fixed.withColumn("mode", F.lit("fixed")))


def bracket_check(spark, folder):
    table = rates.bracket_check(loan_book(spark, folder), benchmark_of(spark, folder), S)
    table = rounded(table, 9, "note_rate", "benchmark_rate", "discount_rate")
    return rounded(table, 6, "spread_bps", "headroom_bps")


def severity_of(spark, folder):
    outcomes = severity.default_outcomes(panel_of(spark, folder), months_of(spark, folder), S)
    return severity.severity(outcomes, S)


def severity_table(spark, folder):
    table = rounded(severity_of(spark, folder), 4, "total_loss", "total_exposure_at_default")
    return rounded(
        table, 9, "probability_of_loss", "lgd_at_default_balance", "lgd_at_disposition",
        "lgd_median", "lgd_p10", "lgd_p90", "effective_lgd", "cure_rate",
    )


def severity_degradation(spark, folder):
    return rounded(
        severity.degradation(severity_of(spark, folder)), 9,
        "frequency_ratio", "severity_ratio", "effective_ratio",
    )


def _defaulted(spark, folder):
    return severity.defaulted_loans(panel_of(spark, folder), months_of(spark, folder), S)


def defaulted_loans(spark, folder):
    return rounded(_defaulted(spark, folder), 4, "original_upb")


def cure_cost(spark, folder):
    costs = severity.cure_costs(_defaulted(spark, folder), rates_of(spark, folder), S)
    table = severity.cure_summary(costs)
    table = rounded(table, 4, "mean_cost", "median_cost", "mean_balance_at_default")
    table = rounded(table, 9, "mean_default_age", "cost_share_of_balance")
    return rounded(table, 2, "total_cost")


def month_steps(spark, folder):
    steps = realised.month_steps(months_of(spark, folder))
    return rounded(steps, 4, "next_upb", "advanced_upb").select(
        "loan_identifier", "period", "month_index", "first_observed_age", "next_upb", "advanced_upb"
    )


def valued_months(spark, folder):
    return realised.valued_months(realised.month_steps(months_of(spark, folder)), S).select(
        "loan_identifier", "period", "month_index", "last_index"
    )


def monthly_flows(spark, folder):
    months = realised.valued_months(realised.month_steps(months_of(spark, folder)), S)
    flows = realised.monthly_flows(months, rates_of(spark, folder), S)
    return rounded(flows, 9, "discount").select(
        "loan_identifier", "month_index", "discount", "interest", "principal", "servicing", "loss"
    )


def _legs(spark, folder):
    return realised.legs_of(months_of(spark, folder), rates_of(spark, folder), S)


def realised_of(spark, folder):
    return realised.realised_npv(_legs(spark, folder), loan_book(spark, folder))


def realised_legs(spark, folder):
    return rounded(
        _legs(spark, folder), 4, "pv_interest", "pv_principal", "pv_loss", "pv_servicing",
        "pv_terminal", "terminal_balance", "realised_loss", "advanced_upb",
        "principal_undiscounted",
    )


def realised_npv(spark, folder):
    table = realised.funded_only(realised_of(spark, folder))
    table = rounded(table, 4, "principal", "npv", "rounding_gap", "advanced_upb")
    return rounded(table, 9, "npv_per_dollar").select(
        "loan_identifier", "origination_vintage", "principal", "npv", "rounding_gap",
        "advanced_upb", "npv_per_dollar",
    )


def portfolio_legs(spark, folder):
    totals = ["advanced", *[f"pv_{leg}_total" for leg in ("interest", "principal", "terminal", "loss", "servicing")], "npv_total"]
    table = rounded(realised.portfolio_legs(realised_of(spark, folder)), 2, *totals)
    table = rounded(table, 9, "loss_share", "alive_share")
    return rounded(table, 4, "npv_per_loan").select("loans", "unfunded", *totals, "npv_per_loan", "loss_share", "alive_share")


def loss_censoring(spark, folder):
    # A short horizon, so that some of the derived losses fall outside it.
    short = replace(S, horizon=3, horizons=(2, 3), binary_window=3)
    table = realised.loss_censoring(realised.month_steps(months_of(spark, folder)), short)
    return rounded(table, 4, "total_loss", "loss_inside_horizon")


def telescoping_audit(spark, folder):
    return rounded(realised.telescoping_audit(_legs(spark, folder)), 4, "largest_gap")


def amortisation_schedule(spark, folder):
    ages = F.array(*[F.lit(a) for a in (0, 12, 60, 120, 359, 360, 400)])
    rows = loan_book(spark, folder).withColumn("age", F.explode(ages))
    terms = (F.col("original_upb"), F.col("original_interest_rate") / 100.0, F.col("original_loan_term"))
    return rows.select(
        "loan_identifier", "age",
        F.round(monthly_payment(*terms), 6).alias("payment"),
        F.round(scheduled_balance(*terms, F.col("age")), 4).alias("balance"),
    )


def loans_of(spark, folder):
    return projection.loan_terms(panel_of(spark, folder), rates_of(spark, folder))


def paths_of(spark, folder, calibrator=None):
    loans = projection.from_origination(loans_of(spark, folder))
    return projection.projected_paths(loans, FIXED_HAZARDS, S, calibrator)


def values_of(spark, folder):
    return projection.loan_values(projection.from_origination(loans_of(spark, folder)), FIXED_HAZARDS, S)


def path_audit(spark, folder):
    loans = projection.from_origination(loans_of(spark, folder))
    paths = projection.projected_paths(loans, FIXED_HAZARDS, S)
    keys = ("origination_vintage", "loan_identifier")
    return rounded(valuation.path_audit(paths, loans, keys), 9, "value")


def loan_npv(spark, folder):
    table = values_of(spark, folder).drop("score", "overflows").withColumn("variant", F.lit("raw"))
    return rounded(rounded(table, 4, *LEGS, "principal", "npv"), 9, "npv_per_dollar")


def portfolio_decomposition(spark, folder):
    table = valuation.portfolio_decomposition(values_of(spark, folder))
    shares = [f"{c}_share" for c in (*LEGS, "npv")]
    table = rounded(rounded(table, 9, *shares), 2, "principal", "npv")
    return rounded(table, 4, "npv_per_loan").select("loans", "principal", "npv", *shares, "npv_per_loan")


QUERIES = {
    "r1_monthly_yields": monthly_yields,
    "r2_benchmark_by_cohort": lambda spark, folder: rounded(
        benchmark_of(spark, folder), 9, "benchmark_rate"
    ),
    "r3_discount_rates": discount_rates,
    "r4_bracket_check": bracket_check,
    "l1_l2_severity": severity_table,
    "l3_severity_degradation": severity_degradation,
    "l4_defaulted_loans": defaulted_loans,
    "l5_cure_cost": cure_cost,
    "z1_month_steps": month_steps,
    "z2_valued_months": valued_months,
    "z3_monthly_flows": monthly_flows,
    "z4_realised_legs": realised_legs,
    "z5_realised_npv": realised_npv,
    "z6_portfolio_legs": portfolio_legs,
    "z7_loss_censoring": loss_censoring,
    "z8_telescoping_audit": telescoping_audit,
    "n1_amortisation_schedule": amortisation_schedule,
    "n2_path_audit": path_audit,
    "n3_n4_loan_npv": loan_npv,
    "n5_portfolio_decomposition": portfolio_decomposition,
}
