"""Registered diagnostic, calibration, projection and decision queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from vintara.functions.scalars import in_share, sigmoid
from vintara.operators import ablation, binary, contrast, decision, fold, hazard, projection, realised
from vintara.operators import reliability as rel
from vintara.operators import selection
from vintara.plans.queries.economics import (
    FIXED_HAZARDS, FIXED_PLATT, RoundedPlatt, fixed_hazards, loans_of, paths_of, realised_of, values_of,
)
from vintara.plans.queries.panel import exits_of, rounded
from vintara.plans.stored import panel_of
from vintara.sources.driver_tables import DRIVER_SETTINGS as S
from vintara.sources.driver_tables import loan_book
from vintara.storage import durable

LOAN = list(hazard.LOAN)
FIXED_SEQUENTIAL = RoundedPlatt(1.0, 0.6)
BOTH = ["population", "variant"]
CUTOFF = 0.2


def scored_of(spark, folder):
    default, prepaid = fixed_hazards()
    return panel_of(spark, folder).withColumns(
        {"hazard_default": default, "hazard_prepayment": prepaid}
    )


def calibration_rows(spark, folder, settings=S):
    scored = FIXED_PLATT.apply(scored_of(spark, folder), "hazard_default", "p_platt")
    scored = FIXED_SEQUENTIAL.apply(scored, "hazard_default", "p_sequential")
    variants = {"raw": "hazard_default", "platt": "p_platt"}
    return rel.calibration_rows(scored, variants, settings, "p_sequential")


def _parts(spark, folder):
    return rel.reliability_parts(calibration_rows(spark, folder), BOTH, S.bins, S.binning)


def scores_of(spark, folder, settings=S):
    return rel.population_scores(calibration_rows(spark, folder, settings), BOTH, settings)


def hazard_scores(spark, folder):
    return rounded(scored_of(spark, folder), 9, "hazard_default", "hazard_prepayment").select(
        "loan_identifier", "loan_age", "hazard_default", "hazard_prepayment"
    )


def survival_paths(spark, folder):
    names = ("survival", "survival_entering", "cif_default", "cif_prepayment")
    return rounded(paths_of(spark, folder), 9, *names).select("loan_identifier", "loan_age", *names)


def fit_by_age(spark, folder):
    return rounded(
        hazard.fit_by_age(scored_of(spark, folder)), 9, "predicted_default", "observed_default",
        "predicted_prepayment", "observed_prepayment",
    )


def marginal_gaps(spark, folder):
    table = hazard.marginal_gaps(scored_of(spark, folder))
    return rounded(rounded(table, 6, "predicted_events"), 9, "base_rate", "marginal_gap")


def loan_frame(spark, folder):
    return binary.loan_frame(panel_of(spark, folder), S).select(
        "loan_identifier", "resolved", binary.TARGET
    )


def _binary_score():
    fico = F.coalesce(F.col("classic_fico"), F.lit(700)) - 700
    cltv = F.col("original_combined_loan_to_value") - 70
    return F.round(sigmoid(-1.5 - 0.006 * fico + 0.015 * cltv), 12)


def _flat_hazards():
    return fold.flat_hazards(_binary_score(), 0.02, S)


def flat_hazard_npv(spark, folder):
    loans = projection.from_origination(loans_of(spark, folder))
    values = projection.loan_values(loans, _flat_hazards(), S)
    return rounded(values, 4, "npv").select("loan_identifier", "npv")


def cohort_residuals(spark, folder):
    table = selection.cohort_residuals(scored_of(spark, folder))
    return rounded(rounded(table, 9, "observed", "predicted", "residual"), 6, "z")


def cohort_bias(spark, folder):
    table = selection.cohort_bias(selection.cohort_residuals(scored_of(spark, folder)), S)
    return rounded(table, 6, "mean_z_all_ages", "mean_z_late_ages")


def probability_audit(spark, folder):
    rows = scored_of(spark, folder).select(
        F.col("hazard_default").alias("predicted"), F.col("default_event").cast("int").alias("observed")
    )
    return rel.probability_audit(rows)


def bin_edges(spark, folder):
    edges = rel.bin_edges(calibration_rows(spark, folder), BOTH, S.bins, S.binning)
    placed = edges.select(*BOTH, F.posexplode("edges").alias("position", "edge"))
    return rounded(placed, 9, "edge")


def reliability(spark, folder):
    table = rel.reliability(calibration_rows(spark, folder), BOTH, S)
    table = rounded(
        table, 9, "mean_predicted", "observed_rate", "min_predicted", "max_predicted", "bin_low",
        "bin_high", "standard_error", "residual",
    )
    return rounded(table, 6, "z")


def uniform_bins(spark, folder):
    rows = scored_of(spark, folder).select(
        F.lit("all").alias("population"), F.col("hazard_default").alias("predicted"),
        F.col("default_event").cast("int").alias("observed"),
    )
    table = rel.reliability(rows, ["population"], replace(S, binning="uniform"))
    return rounded(table, 9, "mean_predicted").select("bin", "rows", "events", "mean_predicted")


def calibration_errors(spark, folder):
    return rounded(rel.calibration_errors(_parts(spark, folder), BOTH), 9, "ece", "max_error")


def brier_parts(spark, folder):
    table = rel.brier_parts(_parts(spark, folder), BOTH).drop("predicted_events")
    return rounded(
        table, 9, "brier", "reliability", "resolution", "uncertainty", "base_rate", "residual",
        "skill",
    )


def platt_apply(spark, folder):
    scored = FIXED_PLATT.apply(scored_of(spark, folder), "hazard_default", "calibrated")
    return rounded(scored, 9, "calibrated").select("loan_identifier", "loan_age", "calibrated")


def keyed_split(spark, folder):
    held = in_share(F.col("loan_identifier"), S.holdout_share, S.holdout_seed)
    return loan_book(spark, folder).select("loan_identifier", held.alias("held"))


def population_scores(spark, folder):
    table = rel.with_sample_flag(scores_of(spark, folder)).drop("residual", "bins_used")
    table = rounded(
        table, 9, "base_rate", "ece", "max_error", "brier", "reliability", "resolution",
        "uncertainty", "skill", "marginal_ratio",
    )
    return rounded(table, 6, "predicted_events")


def harness_checks(spark, folder):
    table = rel.harness_checks(scores_of(spark, folder))
    names = ("in_sample_ratio", "test_ratio", "test_ece", "platt_gap_closed", "sequential_gap_closed")
    return rounded(table, 9, *names).select(
        *names, "in_sample_ok", "under_predicts_out_of_time", "no_leakage"
    )


def projectable_loans(spark, folder):
    loans = projection.from_origination(loans_of(spark, folder))
    return rounded(loans, 9, "discount_rate").select(*LOAN, "discount_rate")


def _variants(sequential=True):
    named = {"raw": None, "platt": FIXED_PLATT}
    return named | {"sequential": FIXED_SEQUENTIAL} if sequential else named


def _variant_paths(spark, folder, cohorts=None, sequential=True):
    loans = projection.from_origination(loans_of(spark, folder))
    if cohorts:
        loans = loans.where(F.col("origination_vintage").isin(*cohorts))
    return projection.variant_paths(loans, FIXED_HAZARDS, _variants(sequential), S)


def projected_paths(spark, folder):
    names = ("hazard_default", "hazard_prepayment", "survival_entering", "cif_default")
    return rounded(_variant_paths(spark, folder, sequential=False), 9, *names).select(
        "variant", "loan_identifier", "loan_age", *names
    )


def cumulative_calibration(spark, folder):
    paths = paths_of(spark, folder).where(F.col("origination_vintage").isin(*S.test_cohorts))
    table = projection.cumulative_calibration(paths, S, "test (out-of-time)")
    return rounded(table, 9, "observed_rate", "predicted_rate", "ratio", "gap").drop(
        "population", "unmatched"
    )


def _npv_scopes(spark, folder):
    paths = _variant_paths(spark, folder, S.test_cohorts)
    return projection.portfolio_npv(projection.portfolio_sums(paths, S), S, projection.scope_cells(S))


def portfolio_npv(spark, folder):
    table = rounded(_npv_scopes(spark, folder), 2, "npv_total", "default_leg")
    table = rounded(rounded(table, 4, "npv_per_loan", "delta_vs_raw"), 9, "npv_per_dollar", "delta_pct")
    return table.select(
        "scope", "variant", "lgd", "discount_spread_bps", "loans", "npv_total", "npv_per_loan",
        "npv_per_dollar", "default_leg", "delta_vs_raw", "delta_pct",
    )


def sensitivity_band(spark, folder):
    band = projection.sensitivity_band(_npv_scopes(spark, folder))
    return rounded(band, 4, "low", "middle", "high")


def applicants_of(spark, folder):
    scored = values_of(spark, folder).select(*LOAN, F.round("score", 12).alias("score"), F.col("npv").alias("expected_npv"))
    paid = realised.funded_only(realised_of(spark, folder))
    return decision.applicants(scored, paid, exits_of(spark, folder), S)


def applicants(spark, folder):
    table = rounded(rounded(applicants_of(spark, folder), 9, "score"), 4, "expected_npv", "realised_npv")
    return table.select(
        "loan_identifier", "score", "expected_npv", "realised_npv", "resolved", "defaulted"
    )


def _books(spark, folder):
    frame = durable(applicants_of(spark, folder))
    cohort = F.col("origination_vintage")
    held = in_share(F.col("loan_identifier"), S.holdout_share, S.holdout_seed)
    return (
        frame.where(cohort.isin(*S.test_cohorts)),
        frame.where(cohort.isin(*S.train_cohorts) & held),
    )


def cutoff_curve(spark, folder):
    frame, _ = _books(spark, folder)
    table = rounded(
        decision.cutoff_curve(frame, S), 9, "approval_rate", "threshold", "accuracy", "precision",
        "recall", "f1",
    )
    return rounded(rounded(table, 2, "npv_total"), 4, "npv_per_applicant")


def rule_table(spark, folder):
    frame, chooser = _books(spark, folder)
    rules = decision.evaluate(frame, S, chooser).rules
    return rounded(rounded(rules, 9, "approval_rate", "threshold", "accuracy", "f1"), 4, "npv_per_applicant")


def accuracy_threshold(spark, folder):
    loans = binary.loan_frame(panel_of(spark, folder), S).select(
        "loan_identifier", "origination_vintage", "resolved", _binary_score().alias("score"),
        F.col(binary.TARGET).alias("defaulted"),
    )
    held = in_share(F.col("loan_identifier"), S.holdout_share, S.holdout_seed)
    chosen = loans.where(F.col("origination_vintage").isin(*S.train_cohorts) & held)
    return rounded(decision.accuracy_threshold(chosen), 9, "threshold", "accuracy")


def detail_of(spark, folder):
    """Every arm's score and expected value on the later test cohorts, from fixed hazards."""
    loans = projection.from_origination(loans_of(spark, folder))
    later = S.test_cohorts[1:]
    loans = loans.where(F.col("origination_vintage").isin(*later))
    arms = {"B3": (FIXED_HAZARDS, None), "B4a": (FIXED_HAZARDS, FIXED_PLATT), "B4b": (FIXED_HAZARDS, FIXED_SEQUENTIAL),
            "B2": (_flat_hazards(), None)}
    values = projection.arm_values(binary.loan_frame(loans, S).withColumn("_p", _binary_score()), arms, S)
    paid = realised.funded_only(realised_of(spark, folder)).select(*LOAN, F.col("npv").alias("realised"))
    scores = {f"score_{a}": F.round(f"score_{a}", 12) for a in ("B3", "B4a", "B4b")}
    values = values.withColumns(scores | {"score_B2": F.col("_p"), "defaulted": F.col(binary.TARGET)})
    return ablation.common_population(values, paid, tuple(arms))


def arms_of(spark, folder):
    detail = durable(detail_of(spark, folder))
    base = detail.agg(ablation.base_rate(detail).alias("r")).first()["r"]
    return ablation.arm_rows(detail, CUTOFF, base)


def score_metrics(spark, folder):
    table = ablation.score_metrics(durable(arms_of(spark, folder)), ["arm"], S)
    return rounded(table, 9, "auc", "gini", "brier", "ece")


def best_prefixes(spark, folder):
    table = ablation.arm_table(arms_of(spark, folder), S)
    return rounded(table, 4, "oracle_rank", "oracle_cut").select("arm", "oracle_rank", "oracle_cut")


def ablation_table(spark, folder):
    table = ablation.arm_steps(ablation.arm_table(arms_of(spark, folder), S))
    table = rounded(table, 4, "realised", "expected", "oracle_rank", "oracle_cut", "vs_floor", "step")
    table = rounded(rounded(table, 6, "capture_rank", "capture_cut"), 9, "approval_rate", "auc", "brier", "ece")
    return table.select(
        "arm", "approval_rate", "threshold", "realised", "expected", "oracle_rank", "oracle_cut",
        "capture_rank", "capture_cut", "auc", "brier", "ece", "vs_floor", "step",
    )


def failure_by_cohort(spark, folder):
    table = ablation.failure_by_cohort(detail_of(spark, folder))
    return rounded(rounded(table, 4, "expected_npv", "realised_npv", "gap"), 9, "default_rate")


def failure_by_risk(spark, folder):
    table = ablation.failure_by_risk(durable(detail_of(spark, folder)))
    table = rounded(table, 4, "expected_npv", "realised_npv", "gap")
    return rounded(table, 9, "default_rate", "mean_score")


def arm_contrast(spark, folder):
    control = replace(S, train_cohorts=(1995, 1996), test_cohorts=(1997, 1998))
    both = scores_of(spark, folder).withColumn("arm", F.lit("crisis")).unionByName(
        scores_of(spark, folder, control).withColumn("arm", F.lit("control"))
    )
    names = (
        "train_base_rate", "test_base_rate", "in_sample_ratio", "holdout_ratio", "test_ratio",
        "ece_over_base_rate", "base_rate_shift", "shortfall", "platt_closes", "sequential_closes",
    )
    return rounded(contrast.arm_contrast(both), 9, *names).select("arm", *names)


QUERIES = {
    "h2_hazard_scores": hazard_scores,
    "h3_survival_paths": survival_paths,
    "h3_survival_audit": lambda spark, folder: hazard.survival_audit(paths_of(spark, folder)),
    "h4_fit_by_age": fit_by_age,
    "h5_marginal_gaps": marginal_gaps,
    "b1_loan_frame": loan_frame,
    "b3_flat_hazard_npv": flat_hazard_npv,
    "m2_cohort_residuals": cohort_residuals,
    "m3_cohort_bias": cohort_bias,
    "k1_probability_audit": probability_audit,
    "k2_bin_edges": bin_edges,
    "k3_k11_reliability": reliability,
    "k3_uniform_bins": uniform_bins,
    "k4_calibration_errors": calibration_errors,
    "k5_brier_parts": brier_parts,
    "k6_platt_apply": platt_apply,
    "k8_keyed_split": keyed_split,
    "k10_population_scores": population_scores,
    "k13_harness_checks": harness_checks,
    "j1_projectable_loans": projectable_loans,
    "j2_projected_paths": projected_paths,
    "j3_cumulative_calibration": cumulative_calibration,
    "j4_j6_portfolio_npv": portfolio_npv,
    "j5_sensitivity_band": sensitivity_band,
    "d1_applicants": applicants,
    "d2_cutoff_curve": cutoff_curve,
    "d3_d4_rule_table": rule_table,
    "a1_accuracy_threshold": accuracy_threshold,
    "a2_score_metrics": score_metrics,
    "a3_best_prefixes": best_prefixes,
    "a4_a5_ablation": ablation_table,
    "a6_failure_by_cohort": failure_by_cohort,
    "a7_failure_by_risk": failure_by_risk,
    "a8_arm_contrast": arm_contrast,
}
