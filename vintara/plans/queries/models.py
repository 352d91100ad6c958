"""Registered feature and model-fitting queries."""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.functions.scalars import in_share, logit
from vintara.functions.splines import Spline
from vintara.operators import binary, design, hazard, model_store, recalibration, selection
from vintara.operators import reliability as rel
from vintara.operators.ordering import numbered
from vintara.plans.queries.calibration import scored_of
from vintara.plans.queries.panel import rounded
from vintara.plans.stored import panel_of
from vintara.sources.driver_tables import DRIVER_SETTINGS as S
from vintara.storage import durable, fresh_path

NUMERIC = (*S.spline_columns, *S.linear_columns)
AGE_SPLINE = Spline.uniform(0.0, float(S.horizon), S.age_knots)


def training_panel(spark, folder):
    return panel_of(spark, folder).where(F.col("origination_vintage").isin(*S.train_cohorts))


def training_loans(spark, folder):
    return design.loans_with_months(training_panel(spark, folder))


def usability(spark, folder):
    columns = [*NUMERIC, *S.categorical_columns, "vantagescore_4_0"]
    return design.usability(training_loans(spark, folder), columns)


def numeric_statistics(spark, folder):
    """Median, knots, mean and deviation per numeric column, weighted by months."""
    loans = training_loans(spark, folder)
    raw = {c: design.raw_value(c) for c in NUMERIC}
    steps = [i / (S.age_knots - 1) for i in range(S.age_knots)]
    placed = design.numeric_quantiles(loans, raw, [0.5, *steps])
    out = placed.join(design.numeric_moments(loans, raw), "column")
    knots = F.array_distinct(F.slice("quantiles", 2, len(steps)))
    return out.select(
        "column", F.round(F.get("quantiles", F.lit(0)), 9).alias("median"),
        F.array_join(F.transform(knots, lambda k: F.round(k, 6).cast("string")), " ").alias("knots"),
        F.round("mean", 9).alias("mean"), F.round("deviation", 9).alias("deviation"),
    )


def level_shares(spark, folder):
    table = design.level_shares(training_loans(spark, folder), S.categorical_columns)
    return rounded(table, 9, "share").withColumn("kept", F.col("share") >= S.min_level_share)


def age_basis(spark, folder):
    rows = panel_of(spark, folder).select("loan_age").distinct()
    basis = AGE_SPLINE.columns("CAST(loan_age AS DOUBLE)")
    return rows.select("loan_age", *[F.round(F.expr(c), 9).alias(f"b{i}") for i, c in enumerate(basis)])


def covariate_basis(spark, folder):
    """Every spline block of the fitted design at every value the training loans take, imputed ones included."""
    loans = training_loans(spark, folder)
    spec = design.fit_spec(loans, S)
    parts = []
    for name, spline in spec.splines.items():
        raw = design.raw_value(name)
        points = loans.groupBy(
            F.coalesce(raw, F.lit(spec.medians[name])).alias("value"), raw.isNull().alias("missing")
        ).agg(F.count(F.lit(1)).alias("loans"))
        entries = [F.struct(F.lit(i).alias("position"), F.round(F.expr(c), 9).alias("basis")) for i, c in enumerate(spline.columns("value"))]
        parts.append(points.select(F.lit(name).alias("column"), F.round("value", 6).alias("value"), "missing", "loans", F.inline(F.array(*entries))))
    return reduce(DataFrame.unionByName, parts)


def encoded_design(spark, folder):
    """The whole fitted design at each training loan's first month, one row per loan and feature."""
    loans = training_loans(spark, folder)
    spec = design.fit_spec(loans, S)
    entries = [
        F.struct(F.lit(n).alias("feature"), F.round(c, 7).alias("value")) for n, c in zip(spec.names, spec.columns())
    ]
    return loans.select("loan_identifier", F.inline(F.array(*entries)))


def fitting_panel(spark, folder):
    held = in_share(F.col("loan_identifier"), S.holdout_share, S.holdout_seed)
    return training_panel(spark, folder).where(~held).select(*design.model_columns(S))


@lru_cache(maxsize=8)
def fitted(spark, folder):
    """Hazards fitted on the training loans outside the holdout."""
    return hazard.fit_hazards(fitting_panel(spark, folder), S, S.holdout_share)


def hazard_fit(spark, folder):
    models = fitted(spark, folder)
    return models.fit_table(spark).select(
        "cause", "rows", "events", F.round("base_rate", 9).alias("base_rate"),
        (F.col("converged") & (F.abs("marginal_gap") < 1e-3)).alias("converged"),
        (F.col("iterations") < S.max_iterations).alias("below_cap"),
    )


def coefficients(spark, folder):
    return fitted(spark, folder).causes["default"].coefficient_table(spark)


def score_equations(spark, folder):
    """What the fits predict, weighted by each feature. At the optimum it is what the events give, which the oracle sums."""
    table = hazard.score_equations(fitted(spark, folder).causes, hazard.EVENTS, fitting_panel(spark, folder), S)
    return table.select("cause", "feature", _weighted())


def _weighted():
    value = F.round(F.col("predicted") + F.col("penalty"), 1)
    return F.when(value == 0.0, F.lit(0.0)).otherwise(value).alias("weighted_events")


def model_card(spark, folder):
    """Save and reload the fitted models under the same settings."""
    path = fresh_path(spark, "models")
    model_store.save(spark, fitted(spark, folder), path)
    loaded = model_store.load(spark, path, S)
    return model_store.card(spark, path).select(
        "format_version", "horizon", "holdout_share",
        F.lit(sorted(loaded.causes)[0]).alias("first_cause"),
        F.lit(len(loaded.causes)).alias("causes"),
        (F.col("fingerprint") == model_store.fingerprint(S)).alias("matches"),
    )


@lru_cache(maxsize=8)
def fitted_binary(spark, folder):
    return binary.fit_binary(_binary_loans(spark, folder), S)


def _binary_loans(spark, folder):
    held = in_share(F.col("loan_identifier"), S.holdout_share, S.holdout_seed)
    return binary.loan_frame(training_panel(spark, folder).where(~held), S)


def binary_fit(spark, folder):
    model = fitted_binary(spark, folder)
    return spark.createDataFrame(
        [(model.logit.rows, model.logit.events, model.unresolved, abs(model.logit.marginal_gap) < 1e-3)],
        "rows bigint, events bigint, unresolved bigint, converged boolean",
    )


def binary_score_equations(spark, folder):
    """The same equations for the binary model, over its resolved loans."""
    loans = _binary_loans(spark, folder).where("resolved")
    table = hazard.score_equations({"window": fitted_binary(spark, folder).logit}, {"window": binary.TARGET}, loans, S)
    return table.select("feature", _weighted())


@lru_cache(maxsize=8)
def _study(spark, folder):
    panel = training_panel(spark, folder).select(*design.model_columns(S))
    return durable(selection.knot_study(panel, S))


def knot_study(spark, folder):
    """Likelihood and both criteria for each knot count of the study."""
    return _study(spark, folder)


def knot_penalties(spark, folder):
    """What the two criteria add to the likelihood, which depends on the design and the sample alone."""
    deviance = -2.0 * F.col("log_likelihood")
    return _study(spark, folder).select(
        "knots", "parameters", F.round(F.col("bic_by_rows") - deviance, 5).alias("penalty_by_rows"),
        F.round(F.col("bic_by_events") - deviance, 5).alias("penalty_by_events"),
        (F.abs("marginal_gap") < 1e-3).alias("converged"),
    )


def _held_rows(spark, folder):
    rows = rel.calibration_rows(scored_of(spark, folder), {"raw": "hazard_default"}, S)
    return rows.where(F.col("population") == rel.HOLDOUT).select("predicted", "observed")


def platt_fit(spark, folder):
    """Both score equations of a fitted Platt map: its predictions, plain and weighted by the log-odds."""
    rows = _held_rows(spark, folder)
    fit = recalibration.fit_platt(rows, S)
    return fit.apply(rows, "predicted", "calibrated").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("observed").cast("bigint").alias("events"),
        F.round(F.sum("calibrated"), 3).alias("weighted_events"),
        F.round(F.sum(F.col("calibrated") * logit(F.col("predicted"))), 3).alias("weighted_log_odds"),
    )


def isotonic_fit(spark, folder):
    """The isotonic map keeps every row and, before its cap, the events; it never falls from one prediction to the next."""
    rows = _held_rows(spark, folder)
    fit = recalibration.fit_isotonic(rows, S)
    free = replace(fit, ceiling=None)
    both = free.apply(fit.apply(rows, "predicted", "calibrated"), "predicted", "free")
    points = both.groupBy("predicted").agg(
        F.max("calibrated").alias("calibrated"), F.max("free").alias("free"), F.count(F.lit(1)).alias("n")
    )
    ordered, _ = numbered(points, ["predicted"], "at")
    before = ordered.select((F.col("at") + 1).alias("at"), F.col("calibrated").alias("before"))
    return ordered.join(before, "at", "left").agg(
        F.sum("n").alias("rows"), F.round(F.sum(F.col("free") * F.col("n")), 4).alias("weighted_events"),
        F.count_if(F.col("calibrated") < F.col("before")).alias("falls"),
        F.count_if(~F.col("calibrated").between(0.0, fit.ceiling)).alias("outside"),
    )


def score_rows(spark, folder):
    """Fitted hazards on every panel row: population, rows and events of the scored table."""
    scored = fitted(spark, folder).score(panel_of(spark, folder))
    rows = rel.calibration_rows(scored, {"raw": "hazard_default"}, S)
    return rows.groupBy("population").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("observed").cast("bigint").alias("events"),
        (F.count_if(F.col("predicted").between(0.0, 1.0)) == F.count(F.lit(1))).alias("probabilities"),
    )


def sequential_recalibration(spark, folder):
    """A Platt map fitted on the first test cohort, applied to the later ones."""
    cohort = F.col("origination_vintage")
    rows = rel.calibration_rows(scored_of(spark, folder), {"raw": "hazard_default"}, S)
    test = rows.where(F.col("population") == rel.TEST)
    first, *later = S.test_cohorts
    fit = recalibration.fit_platt(test.where(cohort == first), S)
    out = fit.apply(test.where(cohort.isin(*later)), "predicted", "calibrated")
    return out.groupBy("origination_vintage").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("observed").cast("bigint").alias("events"),
        F.max(F.col("calibrated") <= 1.0).alias("probabilities"),
    )


QUERIES = {
    "f1_usability": usability,
    "f2_numeric_statistics": numeric_statistics,
    "f3_level_shares": level_shares,
    "f4_age_basis": age_basis,
    "f4_covariate_basis": covariate_basis,
    "f5_encoded_design": encoded_design,
    "h1_hazard_fit": hazard_fit,
    "h5_coefficients": coefficients,
    "h5_score_equations": score_equations,
    "h6_model_card": model_card,
    "b2_binary_fit": binary_fit,
    "b2_score_equations": binary_score_equations,
    "m1_knot_study": knot_study,
    "m1_knot_penalties": knot_penalties,
    "k6_platt_fit": platt_fit,
    "k7_isotonic_fit": isotonic_fit,
    "k9_score_rows": score_rows,
    "k12_sequential": sequential_recalibration,
}
