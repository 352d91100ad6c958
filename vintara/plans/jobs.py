"""The pipeline stages as functions: what a scheduled Spark application would call.

Each stage reads stored tables, writes stored tables or small reports, and leaves
nothing in driver memory but fitted parameters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintara.functions.scalars import in_share
from vintara.operators import (
    ablation, binary, curves, decision, fold, hazard, model_store, panel, projection, realised, severity, valuation,
)
from vintara.operators import recalibration as recal
from vintara.operators import reliability as rel
from vintara.operators import selection
from vintara.operators.rates import require_rates
from vintara.operators.design import model_columns
from vintara.operators.hazard import LOAN, HazardModels
from vintara.settings import Settings
from vintara.sources import loan_files, loan_schema, panel_store
from vintara.storage import durable, staged, with_counts

Report = Callable[[str, DataFrame], None]


def report_to(path: str) -> Report:
    """Write each small result as one CSV below ``path``."""
    return lambda name, table: panel_store.write_report(table, f"{path}/{name}")


def ingest(spark: SparkSession, folder: str, settings: Settings) -> dict[str, DataFrame]:
    """Text files to typed tables: missing cohorts and repeated keys stop the job."""
    loan_files.require_files(spark, folder, settings)
    out: dict[str, DataFrame] = {}
    losses: list[tuple[str, str, int]] = []
    for kind, columns in loan_schema.TABLES.items():
        raw = loan_files.scan_cohorts(spark, folder, kind, settings)
        rows, lost = loan_files.typed_and_losses(raw, columns)
        out[kind] = staged(rows, kind, (loan_schema.COHORT,))
        losses += [(kind, column, count) for column, count in lost().items()]
    loan_files.require_unique(out["origination"], out["performance"])
    out["summary"] = loan_files.load_summary(out["origination"], out["performance"])
    out["cast_losses"] = spark.createDataFrame(losses, "table string, column string, lost bigint")
    return out


class FaultyWrite(RuntimeError):
    """The panel that was written is not the one its exits imply."""


def build_panel(
    performance: DataFrame, origination: DataFrame, settings: Settings, path: str, report: Report
) -> DataFrame:
    """The panel by cohort, its report, and the cohort curves.

    Rows, loans and events are counted while the panel is written and must be those that the exits imply.
    """
    rows, written = with_counts(panel.build_panel(performance, origination, settings), panel.written_counts())
    panel_store.write_panel(rows, path)
    table = durable(panel.panel_report(performance, origination, settings))
    report("panel_report", table)
    implied = table.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in panel.written_counts()]).first().asDict()
    if implied != written():
        raise FaultyWrite(f"written {written()}, implied by the exits {implied}")
    stored = panel_store.read_panel(performance.sparkSession, path)
    table = durable(curves.cohort_curves(stored, settings))
    report("cohort_curves", curves.smoothed(table, "hazard_default"))
    report("horizon_summary", curves.horizon_summary(table, settings))
    report("calendar_hazards", curves.without_last_month(curves.calendar_hazards(stored, settings)))
    return stored


def measure_severity(
    stored: DataFrame, performance: DataFrame, rates: DataFrame, settings: Settings, report: Report
) -> None:
    require_rates(rates, settings)
    table = durable(severity.severity(severity.default_outcomes(stored, performance, settings), settings))
    report("severity", table)
    report("severity_degradation", severity.degradation(table))
    train = stored.where(F.col("origination_vintage").isin(*settings.train_cohorts))
    defaulted = severity.defaulted_loans(train, performance, settings)
    report("cure_cost", severity.cure_summary(severity.cure_costs(defaulted, rates, settings)))


def _held(settings: Settings, share: float):
    return in_share(F.col("loan_identifier"), share, settings.holdout_seed)


def fit_hazards(
    stored: DataFrame, settings: Settings, report: Report, holdout_share: float = 0.0,
    model_path: str | None = None, knot_counts: tuple[int, ...] = (),
) -> HazardModels:
    """Fit on the training cohorts, optionally without the holdout loans, and diagnose."""
    spark = stored.sparkSession
    train = stored.where(F.col("origination_vintage").isin(*settings.train_cohorts))
    train = train.select(*[c for c in model_columns(settings) if c in stored.columns])
    if holdout_share:
        train = train.where(~_held(settings, holdout_share))
    models = hazard.fit_hazards(train, settings, holdout_share)
    if model_path:
        model_store.save(spark, models, model_path)
    scored = models.score(train)
    report("hazard_fits", models.fit_table(spark))
    report("hazard_score_equations", hazard.score_equations(models.causes, hazard.EVENTS, train, settings))
    report("hazard_fit_by_age", hazard.fit_by_age(scored))
    residuals = durable(selection.cohort_residuals(scored))
    report("hazard_residuals", residuals)
    report("hazard_cohort_bias", selection.cohort_bias(residuals, settings))
    for cause, model in models.causes.items():
        report(f"hazard_coefficients_{cause}", model.coefficient_table(spark))
    if knot_counts:
        report("hazard_knot_study", selection.knot_study(train, settings, knot_counts=knot_counts))
    return models


@dataclass(frozen=True)
class Calibration:
    calibrators: dict[str, recal.Calibrator]
    sequential: recal.Platt | None
    scores: DataFrame
    horizons: DataFrame
    npv: DataFrame


def require_priced(found: dict, strict: bool) -> None:
    """Refuse values whose paths do not hold: hazards that reach one, or loans without complete terms."""
    if found["unpriced"]:
        raise valuation.PathError(f"{found['unpriced']} loans have terms that give no value")
    if strict and found["overflows"]:
        raise hazard.HazardOverflow(f"{found['overflows']} months with total hazard of one or more")


def calibrate(
    stored: DataFrame, models: HazardModels, rates: DataFrame, settings: Settings, report: Report,
    strict: bool = True,
) -> Calibration:
    """Measure calibration in and out of time, recalibrate, and price the difference.

    Projected months whose hazards add up to one or more are refused, whichever variant has them; with
    ``strict`` off they are reported, and marked in the rows of the values they spoil.
    """
    if not models.holdout_share:
        raise ValueError("calibration needs models fitted without the holdout loans")
    if models.holdout_share != settings.holdout_share:
        raise ValueError(
            f"models leave out {models.holdout_share} of the loans, the settings {settings.holdout_share}"
        )
    require_rates(rates, settings)
    scored = stored.select(
        "loan_identifier", "origination_vintage", "default_event",
        models.causes["default"].probability().alias("p_raw"),
    )
    # Scored once; the calibrators and every score read these slim rows.
    scored = staged(scored, "scored")
    rows = scored.withColumnsRenamed({"p_raw": "predicted"}).withColumn(
        "observed", F.col("default_event").cast("double")
    )
    cohort = F.col("origination_vintage")
    held = _held(settings, models.holdout_share)
    calibrators = recal.fit_calibrators(
        rows.where(cohort.isin(*settings.train_cohorts) & held), settings
    )
    first, *later = settings.test_cohorts
    opening = rows.where(cohort == first)
    sequential = None
    if later and not opening.where("observed = 1").isEmpty():
        sequential = recal.fit_platt(opening, settings)
    variants = {"raw": "p_raw"}
    for name, calibrator in calibrators.items():
        scored = calibrator.apply(scored, "p_raw", f"p_{name}")
        variants[name] = f"p_{name}"
    if sequential:
        scored = sequential.apply(scored, "p_raw", "p_sequential")
    labelled = rel.calibration_rows(scored, variants, settings, "p_sequential" if sequential else None)
    groups = ["population", "variant"]
    parts = durable(rel.reliability_parts(labelled, groups, settings.bins, settings.binning))
    scores = durable(rel.with_sample_flag(rel.scores_from_parts(parts, groups)))
    report("calibration_reliability", parts.drop("sum_predicted", "sum_squared"))
    report("calibration_scores", scores)
    report("calibration_checks", rel.harness_checks(scores))

    loans = projection.from_origination(projection.loan_terms(stored, rates))
    loans = loans.where(cohort.isin(*settings.test_cohorts))
    score = fold.model_hazards(models, settings)
    named: dict[str, recal.Calibrator | None] = {"raw": None, **calibrators}
    if sequential:
        named["sequential"] = sequential
    sums = durable(projection.portfolio_sums(projection.variant_paths(loans, score, named, settings), settings))
    # Ages come from a sequence, so a loan's span has no gaps.
    audit = durable(sums.agg(F.lit(0).alias("month_gaps"), F.coalesce(F.sum("overflows"), F.lit(0)).alias("overflows")))
    report("survival_audit", audit)
    if strict and audit.first()["overflows"]:
        raise hazard.HazardOverflow(f"{audit.first()['overflows']} months with total hazard of one or more")
    raw = projection.projected_paths(loans, score, settings)
    horizons = durable(projection.cumulative_calibration(raw, settings, rel.TEST))
    projection.require_matched(horizons)
    report("calibration_by_horizon", horizons)
    npv = durable(projection.portfolio_npv(sums, settings, projection.scope_cells(settings)))
    report("calibration_npv", npv)
    report("calibration_sensitivity", projection.sensitivity_band(npv))
    return Calibration(calibrators, sequential, scores, horizons, npv)


def realised_values(
    performance: DataFrame, origination: DataFrame, rates: DataFrame, settings: Settings
) -> DataFrame:
    """Realised value per funded loan, stored; refuses loans without an origination record."""
    paid = staged(realised.measure(performance, origination, rates, settings), "realised")
    realised.require_origination(paid)
    return paid


def decide(
    stored: DataFrame, performance: DataFrame, origination: DataFrame, models: HazardModels,
    rates: DataFrame, settings: Settings, report: Report, calibrator: recal.Calibrator | None = None,
    strict: bool = True,
) -> decision.Decision:
    """Compare approval rules on the test book, thresholds chosen on the in-time holdout.

    Loans without a value are refused, and hazards that reach one unless ``strict`` is off; both are counted while the values are stored.
    """
    require_rates(rates, settings)
    loans = projection.from_origination(projection.loan_terms(stored, rates))
    values, found = with_counts(
        projection.loan_values(loans, fold.model_hazards(models, settings), settings, calibrator), projection.value_faults("npv")
    )
    values = staged(values, "loan-values")
    require_priced(found(), strict)
    paid = realised_values(performance, origination, rates, settings)
    scored = values.select(*LOAN, "score", F.col("npv").alias("expected_npv"))
    outcome = loans.select(*LOAN, "exit_age", "exit_reason")
    frame = staged(decision.applicants(scored, paid, outcome, settings), "applicants")
    cohort = F.col("origination_vintage")
    test = frame.where(cohort.isin(*settings.test_cohorts))
    chooser = frame.where(cohort.isin(*settings.train_cohorts) & _held(settings, models.holdout_share or settings.holdout_share))
    result = decision.evaluate(test, settings, chooser)
    report("decision_curve", result.curve)
    report("decision_rules", result.rules)
    return result


def ablate(
    stored: DataFrame, performance: DataFrame, origination: DataFrame, models: HazardModels,
    rates: DataFrame, calibration: Calibration, settings: Settings, report: Report, strict: bool = True,
) -> DataFrame:
    """Every arm on one population of later test cohorts, and where the hazard arm fails.

    Refuses what ``decide`` refuses, for every arm.
    """
    require_rates(rates, settings)
    cohort = F.col("origination_vintage")
    loans = projection.loan_terms(stored, rates)
    train = binary.loan_frame(loans.where(cohort.isin(*settings.train_cohorts)), settings)
    held = _held(settings, models.holdout_share)
    model = binary.fit_binary(train.where(~held), settings)
    report("binary_coefficients", model.logit.coefficient_table(stored.sparkSession))
    chosen = train.where(held).select(
        "loan_identifier", "resolved", F.col(binary.TARGET).alias("defaulted"),
        model.logit.probability().alias("score"),
    )
    cutoff = decision.accuracy_threshold(chosen).first()["threshold"]

    later = projection.from_origination(loans).where(cohort.isin(*settings.test_cohorts[1:]))
    later = binary.loan_frame(later, settings).withColumns({"_p": model.logit.probability(), "defaulted": F.col(binary.TARGET)})
    score = fold.model_hazards(models, settings)
    variants: dict[str, recal.Calibrator | None] = {"B3": None}
    if "platt" in calibration.calibrators:
        variants["B4a"] = calibration.calibrators["platt"]
    if calibration.sequential:
        variants["B4b"] = calibration.sequential
    prepayment = models.causes["prepayment"].base_rate
    arms: dict = {name: (score, calibrator) for name, calibrator in variants.items()}
    arms["B2"] = (fold.flat_hazards(F.col("_p"), prepayment, settings), None)
    values = projection.arm_values(later, arms, settings).withColumn("score_B2", F.col("_p"))
    values, found = with_counts(values, projection.value_faults(*[f"expected_{a}" for a in arms]))
    values = staged(values, "arm-values")
    require_priced(found(), strict)
    paid = realised_values(performance, origination, rates, settings)
    paid = paid.select(*LOAN, F.col("npv").alias("realised"))
    detail = staged(ablation.common_population(values, paid, tuple(arms)), "ablation-detail")
    rate = detail.agg(ablation.base_rate(detail).alias("r")).first()["r"]
    table = ablation.arm_table(ablation.arm_rows(detail, cutoff, rate, tuple(variants)), settings)
    table = durable(ablation.arm_steps(table))
    report("ablation", table)
    report("failure_by_cohort", ablation.failure_by_cohort(detail))
    report("failure_by_risk", ablation.failure_by_risk(detail))
    return table
