"""Evidence for the model specification: knot study and cohort residuals."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.operators.design import fit_specs, loans_with_months
from vintara.operators.hazard import EVENTS, fitting_matrices, model_of, problems_of
from vintara.operators.newton import fit_all, log_likelihoods
from vintara.settings import Settings


def knot_study(
    panel: DataFrame, settings: Settings, cause: str = "default",
    knot_counts: tuple[int, ...] = (6, 9, 12, 16),
) -> DataFrame:
    """Refit one cause per knot count and score the fits by two BIC variants; all counts share their passes."""
    event, table, loans = EVENTS[cause], [], loans_with_months(panel)
    # Every count is checked as a setting.
    specs = fit_specs(loans, settings, [replace(settings, age_knots=knots).age_knots for knots in knot_counts])
    with fitting_matrices(panel, loans, specs, {event: F.col(event)}) as (held, kept, rows):
        problems, (events,) = problems_of(held, [event], specs, settings, kept, rows)
        fits = fit_all(held, problems, settings)
        likelihoods = log_likelihoods(held, problems, fits)
    for knots, spec, positions, fit, likelihood in zip(knot_counts, specs, kept, fits, likelihoods):
        fitted = model_of(spec, positions, rows, events, fit, settings, event)
        size = len(fitted.coefficients) + 1
        table.append(
            (
                knots, size, likelihood, -2 * likelihood + size * math.log(fitted.rows),
                -2 * likelihood + size * math.log(fitted.events), fitted.marginal_gap,
            )
        )
    return panel.sparkSession.createDataFrame(
        table,
        "knots int, parameters int, log_likelihood double, bic_by_rows double, "
        "bic_by_events double, marginal_gap double",
    )


def cohort_residuals(scored: DataFrame, cause: str = "default") -> DataFrame:
    """Standardised residual per cohort and age; null where the error is zero."""
    cells = scored.groupBy(F.col("origination_vintage").alias("vintage"), "loan_age").agg(
        F.count(F.lit(1)).alias("at_risk"),
        F.avg(F.col(EVENTS[cause]).cast("double")).alias("observed"),
        F.avg(f"hazard_{cause}").alias("predicted"),
    )
    mean = F.col("predicted")
    error = F.sqrt(mean * (1.0 - mean) / F.col("at_risk"))
    return cells.withColumn("residual", F.col("observed") - mean).withColumn(
        "z", F.try_divide("residual", F.nullif(error, F.lit(0.0)))
    )


def cohort_bias(residuals: DataFrame, settings: Settings) -> DataFrame:
    """Mean standardised residual per cohort, over all and over late ages."""
    late = F.col("loan_age") >= settings.late_age
    return residuals.groupBy("vintage").agg(
        F.avg("z").alias("mean_z_all_ages"),
        F.avg(F.when(late, F.col("z"))).alias("mean_z_late_ages"),
        F.lit(settings.late_age).alias("late_age"),
    )
