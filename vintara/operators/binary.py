"""The single-window binary default model, and the flat hazard it implies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.functions.scalars import defaulted_by, resolved_by
from vintara.operators.design import fit_spec
from vintara.operators.hazard import LogitModel, NothingToFit, fit_logits, fitting_matrix
from vintara.settings import Settings

TARGET = "defaulted_within"


@dataclass(frozen=True)
class BinaryModel:
    logit: LogitModel
    window: int
    unresolved: int


def loan_frame(panel: DataFrame, settings: Settings) -> DataFrame:
    """One row per loan at its first at-risk month, with the window outcome."""
    window = settings.binary_window
    return panel.where(F.col("loan_age") == F.col("first_observed_age")).withColumns(
        {"resolved": resolved_by(window), TARGET: defaulted_by(window)}
    )


def fit_binary(loans: DataFrame, settings: Settings) -> BinaryModel:
    """Fit on resolved loans with the hazard encoding, without its age block."""
    usable = loans.where("resolved").withColumn("months", F.lit(1).cast("long"))
    counts = loans.agg(
        F.count_if(~F.col("resolved")).alias("unresolved"),
        F.count_if(F.col("resolved") & F.col(TARGET)).alias("events"),
    ).first()
    if not counts["events"]:
        raise NothingToFit(f"no resolved loan defaulted within {settings.binary_window} months")
    spec = fit_spec(usable, settings, include_age=False)
    with fitting_matrix(usable, usable, spec, {TARGET: F.col(TARGET)}) as (held, varying, rows):
        logit, = fit_logits(held, [TARGET], spec, settings, varying, rows)
    return BinaryModel(logit, settings.binary_window, counts["unresolved"])
