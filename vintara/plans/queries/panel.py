"""Registered panel and curve queries over the given tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.operators import curves, panel
from vintara.plans.stored import months_of, panel_of
from vintara.sources.driver_tables import DRIVER_SETTINGS as S
from vintara.sources.driver_tables import loan_book, loan_months


def rounded(frame: DataFrame, places: int, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, places) for c in columns})


def built_panel(spark, folder, settings=S) -> DataFrame:
    return panel.build_panel(months_of(spark, folder), loan_book(spark, folder), settings)


def exits_of(spark, folder, settings=S) -> DataFrame:
    return panel.build_exits(months_of(spark, folder), loan_book(spark, folder), settings)


def curves_of(spark, folder) -> DataFrame:
    return curves.cohort_curves(panel_of(spark, folder), S)


def adapter_months(spark, folder):
    months = loan_months(spark, folder)
    months = rounded(months, 5, "actual_loss")
    return rounded(months, 4, "current_actual_upb", "zero_balance_removal_upb").select(
        "loan_identifier", "origination_vintage", "period", "period_date", "loan_age",
        "remaining_months_to_legal_maturity", "current_actual_upb", "current_interest_rate",
        "current_loan_delinquency_status", "zero_balance_code", "zero_balance_removal_upb",
        "actual_loss",
    )


def sequence_months(spark, folder):
    return panel.sequence_months(months_of(spark, folder)).rows.select(
        "loan_identifier", "period", "loan_age", "previous_loan_age", "loan_age_reset",
        "follows_month_gap",
    )


def _classified(spark, folder):
    return panel.classified(months_of(spark, folder), S).rows


def classify_months(spark, folder):
    return _classified(spark, folder).select(
        "loan_identifier", "period", "missed_payments", "at_or_past_delinquency_threshold",
        "terminated_credit_event", "terminated_prepaid", "terminated_informative",
        "implied_original_term", "delinquency_exceeds_loan_age",
    )


def sticky_breaks(spark, folder):
    return _classified(spark, folder).select(
        "loan_identifier", "period", "clock_broken", "after_month_gap"
    )


def eligible_window(spark, folder):
    return _classified(spark, folder).where("eligible").select(
        "loan_identifier", "period", "loan_age"
    )


def loan_histories(spark, folder):
    months = panel.classified(months_of(spark, folder), S)
    return panel.loan_histories(months).drop(
        "origination_vintage", "any_delinquency_exceeds_loan_age"
    )


def off_clock_kept(spark, folder):
    kept = built_panel(spark, folder, replace(S, exclude_off_clock=False))
    # One row per loan sits at its first observed age, so no distinct is needed.
    entering = F.col("loan_age") == F.col("first_observed_age")
    return kept.groupBy("exit_reason").agg(
        F.count(F.lit(1)).alias("months"), F.count_if(entering).alias("loans"),
        F.count_if("default_event").alias("events"),
    )


def default_by_termination(spark, folder):
    return exits_of(spark, folder, replace(S, default_mode="termination")).groupBy(
        "origination_vintage", "exit_reason"
    ).agg(F.count(F.lit(1)).alias("loans"), F.sum("exit_age").alias("exit_age_total"))


def months_to_disposition(spark, folder):
    gap = "months_delinquent_to_disposition"
    return exits_of(spark, folder).where(F.col(gap).isNotNull()).groupBy(
        "origination_vintage", F.col(gap).cast("bigint").alias(gap)
    ).agg(F.count(F.lit(1)).alias("loans"))


def quality_flags(spark, folder):
    return exits_of(spark, folder).groupBy("origination_vintage").agg(
        F.count_if("credit_event_preceded_delinquency").alias("event_first"),
        F.count_if("entered_after_horizon").alias("late_entry"),
        F.count_if("clock_reset_within_horizon").alias("reset_inside"),
    )


def person_panel(spark, folder):
    table = rounded(built_panel(spark, folder), 5, "actual_loss")
    return rounded(table, 4, "current_actual_upb", "original_upb").select(
        "loan_identifier", "origination_vintage", "loan_age", "period", "period_date", "exit_age",
        "exit_reason", "is_exit_month", "default_event", "prepayment_event", "first_observed_age",
        "ever_clock_reset", "current_actual_upb", "current_loan_delinquency_status",
        "missed_payments", "modification_flag", "zero_balance_code", "actual_loss", "classic_fico",
        "original_combined_loan_to_value", "original_debt_to_income_ratio", "original_upb",
        "original_interest_rate", "original_loan_term",
    )


def panel_report(spark, folder):
    report = panel.panel_report(months_of(spark, folder), loan_book(spark, folder), S)
    return rounded(report, 9, "mean_months_at_risk").select(
        "cohort_loans", "loans_without_eligible_months", "rows", "loans", "events",
        "left_truncated_loans", "seasoned_loans", "off_clock_loans", "excluded_loans",
        "clock_reset_loans", "month_gap_loans", "loans_missing_origination",
        "loans_missing_performance", "exits_default", "exits_month_gap_censor",
        "mean_months_at_risk", "reconciles",
    )


def risk_sets(spark, folder):
    return curves.risk_sets(panel_of(spark, folder))


def cohort_curves(spark, folder):
    return rounded(
        curves_of(spark, folder), 9, "hazard_default", "hazard_prepay", "survival",
        "survival_entering", "km_default", "cif_default", "cif_prepay", "naive_default",
        "naive_prepay", "naive_censored", "not_yet_exited_share",
    )


def calendar_hazards(spark, folder):
    # The derived cohorts are small, so the thin-cell floor is 20 loans here.
    cells = curves.calendar_hazards(panel_of(spark, folder), S, min_cell=20)
    return rounded(curves.without_last_month(cells), 9, "mean_loan_age", "hazard_default")


def horizon_summary(spark, folder):
    summary = curves.horizon_summary(curves_of(spark, folder), S)
    return rounded(summary, 9, "cif_default", "km_default", "km_overstatement", "naive_gap").select(
        "vintage", "loan_age", "cif_default", "km_default", "km_overstatement", "naive_gap",
        "km_at_least_cif", "split",
    )


def smoothed_hazard(spark, folder):
    smooth = curves.smoothed(curves_of(spark, folder), "hazard_default")
    return rounded(smooth, 9, "hazard_default_smooth").select(
        "vintage", "loan_age", "hazard_default_smooth"
    )


QUERIES = {
    "adapter_months": adapter_months,
    "p1_sequence_months": sequence_months,
    "p2_classify_months": classify_months,
    "p3_sticky_breaks": sticky_breaks,
    "p4_eligible_window": eligible_window,
    "p5_p6_loan_histories": loan_histories,
    "p7_loan_exits": lambda spark, folder: exits_of(spark, folder).withColumn(
        "months_delinquent_to_disposition",
        F.col("months_delinquent_to_disposition").cast("bigint"),
    ),
    "p8_off_clock_kept": off_clock_kept,
    "p9_default_by_termination": default_by_termination,
    "p10_months_to_disposition": months_to_disposition,
    "p11_quality_flags": quality_flags,
    "p12_panel": person_panel,
    "p13_panel_report": panel_report,
    "v1_risk_sets": risk_sets,
    "v2_v5_cohort_curves": cohort_curves,
    "v6_calendar_hazards": calendar_hazards,
    "v7_horizon_summary": horizon_summary,
    "v8_smoothed_hazard": smoothed_hazard,
}
