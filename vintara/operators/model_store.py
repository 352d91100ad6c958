"""Fitted hazards in storage, with a card that says what they mean.

Scoring with a model fitted under another event definition gives plausible numbers,
so a fingerprint of the settings that define a fit is stored and checked on load.
"""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from vintara.operators.design import DesignSpec
from vintara.operators.hazard import HazardModels, LogitModel
from vintara.settings import Settings

FORMAT_VERSION = 2

#: Settings that change what a fit means. Economics and calibration are left out:
#: they change how a fit is used.
FIT_DEFINING = (
    "release", "source", "train_cohorts", "horizon", "default_mode", "delinquency_threshold",
    "credit_event_codes", "informative_codes", "exclude_off_clock", "age_knots", "spline_columns",
    "linear_columns", "categorical_columns", "min_level_share", "inverse_penalty", "tolerance",
)

CARD = (
    "format_version int, fitted_at string, fingerprint string, release int, horizon int, "
    "default_mode string, delinquency_threshold int, train_cohorts string, features int, "
    "holdout_share double"
)
CAUSE = (
    "cause string, intercept double, coefficients array<double>, rows bigint, events bigint, "
    "predicted_events double, iterations int, converged boolean, spec string"
)


class StaleModel(RuntimeError):
    """The stored model was fitted under other settings."""


def fingerprint(settings: Settings) -> str:
    chosen = {name: getattr(settings, name) for name in FIT_DEFINING}
    text = json.dumps([FORMAT_VERSION, chosen], sort_keys=True, default=list)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def save(spark: SparkSession, models: HazardModels, path: str) -> None:
    s, causes = models.settings, models.causes
    features = len(next(iter(causes.values())).spec.names)
    row = (
        FORMAT_VERSION, datetime.now(UTC).isoformat(timespec="seconds"), fingerprint(s), s.release,
        s.horizon, s.default_mode, s.delinquency_threshold, json.dumps(s.train_cohorts), features,
        float(models.holdout_share),
    )
    spark.createDataFrame([row], CARD).coalesce(1).write.mode("overwrite").json(f"{path}/card")
    rows = [
        (
            c, m.intercept, list(m.coefficients), m.rows, m.events, m.predicted_events,
            m.iterations, m.converged, m.spec.to_json(),
        )
        for c, m in causes.items()
    ]
    spark.createDataFrame(rows, CAUSE).coalesce(1).write.mode("overwrite").parquet(f"{path}/causes")


def card(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CARD).json(f"{path}/card")


def load(spark: SparkSession, path: str, settings: Settings, require_match: bool = True) -> HazardModels:
    """Reload models; refuse them when the settings that define a fit have moved."""
    stored = card(spark, path).first()
    if stored["format_version"] != FORMAT_VERSION:
        raise StaleModel(f"{path} has format {stored['format_version']}, expected {FORMAT_VERSION}")
    if require_match and stored["fingerprint"] != fingerprint(settings):
        raise StaleModel(f"{path} was fitted under other settings; refit it")
    causes = {
        r["cause"]: LogitModel(
            DesignSpec.from_json(r["spec"]), r["intercept"], tuple(r["coefficients"]), r["rows"],
            r["events"], r["predicted_events"], r["iterations"], r["converged"],
        )
        for r in spark.read.parquet(f"{path}/causes").collect()
    }
    return HazardModels(causes, settings, stored["holdout_share"])
