"""Job parameters, checked once when they are built.

Every assumption a job depends on is a field here, so it can be varied with
``dataclasses.replace`` and never hides in a query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass


class SettingsError(ValueError):
    """The parameters contradict each other or the data layout."""


# Fixed values of the public loan-level file layout (release 47).
LAYOUT_RELEASE = 47
KNOWN_EXIT_CODES = ("01", "02", "03", "09", "15", "16", "96")
PREPAID_CODE = "01"
REPOSSESSED_STATUS = "RA"


@dataclass(frozen=True)
class Settings:
    # data
    release: int = LAYOUT_RELEASE
    source: str = "sample"
    train_cohorts: tuple[int, ...] = (2000, 2001, 2002, 2003, 2004)
    test_cohorts: tuple[int, ...] = (2006, 2007, 2008)
    # time axis
    horizon: int = 120
    # event definition
    default_mode: str = "delinquency"
    credit_event_codes: tuple[str, ...] = ("02", "03", "09")
    informative_codes: tuple[str, ...] = ("15", "16", "96")
    severity_codes: tuple[str, ...] = ("02", "03", "09")
    delinquency_threshold: int = 3
    exclude_off_clock: bool = True
    # hazard model
    age_knots: int = 6
    spline_columns: tuple[str, ...] = (
        "classic_fico",
        "original_combined_loan_to_value",
        "original_debt_to_income_ratio",
    )
    linear_columns: tuple[str, ...] = (
        "original_interest_rate",
        "log_original_upb",
        "original_loan_term",
    )
    categorical_columns: tuple[str, ...] = (
        "first_time_homebuyer_indicator",
        "occupancy_status",
        "channel",
        "property_type",
        "loan_purpose",
        "number_of_borrowers",
        "number_of_units",
        "property_state",
    )
    min_level_share: float = 0.005
    inverse_penalty: float = 100.0
    tolerance: float = 1e-8
    max_iterations: int = 2000
    # economics
    rate_mode: str = "treasury_plus_spread"
    yield_series: str = "DGS10"
    spread_bps: float = 100.0
    fixed_rate: float = 0.06
    lgd: float = 0.1330
    loss_probability: float = 0.3697
    recovery_lag: int = 27
    servicing_bps: float = 35.0
    # calibration
    bins: int = 20
    binning: str = "quantile"
    horizons: tuple[int, ...] = (12, 24, 36, 60)
    holdout_share: float = 0.2
    holdout_seed: int = 20260908
    methods: tuple[str, ...] = ("platt", "isotonic")
    isotonic_tail_rows: int = 1000
    sensitivity_share: float = 0.10
    sensitivity_lgds: tuple[float, ...] = (0.10, 0.1330, 0.18, 0.2407)
    sensitivity_spreads: tuple[float, ...] = (50.0, 100.0, 150.0)
    # decision
    binary_window: int = 36
    sweep_points: int = 200
    choose_on_holdout: bool = True

    @property
    def cohorts(self) -> tuple[int, ...]:
        return tuple(sorted({*self.train_cohorts, *self.test_cohorts}))

    @property
    def severity_given_loss(self) -> float:
        return self.lgd / self.loss_probability

    @property
    def late_age(self) -> int:
        """First age counted as late by the cohort diagnostic: the last quarter."""
        return math.floor(0.75 * self.horizon)

    def __post_init__(self) -> None:
        problems = list(self._problems())
        if problems:
            raise SettingsError("; ".join(problems))

    def _problems(self):
        if self.release != LAYOUT_RELEASE:
            yield f"file layout is release {LAYOUT_RELEASE}, settings ask for {self.release}"
        yield from _one_of("source", self.source, ("sample", "standard"))
        yield from _one_of("default_mode", self.default_mode, ("delinquency", "termination"))
        yield from _one_of("rate_mode", self.rate_mode, ("treasury_plus_spread", "fixed"))
        yield from _one_of("binning", self.binning, ("quantile", "uniform"))
        if not self.train_cohorts or not self.test_cohorts:
            yield "both train and test cohorts are needed"
        elif max(self.train_cohorts) >= min(self.test_cohorts):
            yield "every train cohort must come before every test cohort"
        if self.horizon < 1:
            yield "horizon must be at least one month"
        if not 1 <= self.delinquency_threshold <= 99:
            yield "delinquency_threshold must lie in 1..99"
        events, leaving = set(self.credit_event_codes), set(self.informative_codes)
        if not events:
            yield "no credit event code given"
        if unknown := sorted((events | leaving) - set(KNOWN_EXIT_CODES)):
            yield f"unknown exit codes {unknown}"
        if both := sorted(events & leaving):
            yield f"codes {both} are both a credit event and an informative exit"
        if PREPAID_CODE in events:
            yield f"code {PREPAID_CODE} is a voluntary payoff, not a credit event"
        if self.age_knots < 3:
            yield "a cubic age basis needs at least 3 knots"
        if not 0.0 <= self.min_level_share < 1.0:
            yield "min_level_share must lie in [0, 1)"
        if not 0.0 < self.tolerance <= 1e-3:
            yield "tolerance must lie in (0, 1e-3]"
        if self.inverse_penalty <= 0.0:
            yield "inverse_penalty must be positive"
        numeric = [*self.spline_columns, *self.linear_columns]
        if len(set(numeric)) < len(numeric) or set(numeric) & set(self.categorical_columns):
            yield "a model column is listed under two encodings"
        if not -500.0 <= self.spread_bps <= 2000.0:
            yield "spread_bps must lie in [-500, 2000]"
        if self.fixed_rate <= -1.0:
            yield "fixed_rate must exceed -1"
        if not 0.0 <= self.lgd <= 1.0 or not 0.0 < self.loss_probability <= 1.0:
            yield "lgd and loss_probability must be fractions"
        if self.lgd > self.loss_probability:
            yield "lgd above loss_probability implies a severity above 1"
        if self.recovery_lag < 0 or self.servicing_bps < 0.0:
            yield "recovery_lag and servicing_bps must not be negative"
        if self.bins < 2:
            yield "bins must be at least 2"
        if not self.horizons or list(self.horizons) != sorted(set(self.horizons)):
            yield "horizons must be ascending, unique and non-empty"
        elif self.horizons[0] < 1 or self.horizons[-1] > self.horizon:
            yield "horizons must lie between 1 and the panel horizon"
        if not 0.0 < self.holdout_share < 1.0:
            yield "holdout_share must lie in (0, 1)"
        if not self.methods or set(self.methods) - {"platt", "isotonic"}:
            yield "methods must be drawn from platt and isotonic"
        if self.isotonic_tail_rows < 0:
            yield "isotonic_tail_rows must not be negative"
        if not 1 <= self.binary_window <= self.horizon:
            yield "binary_window must lie between 1 and the panel horizon"
        if self.sweep_points < 10:
            yield "sweep_points must be at least 10"


def _one_of(name: str, value: str, allowed: tuple[str, ...]):
    if value not in allowed:
        yield f"{name} must be one of {allowed}, got {value!r}"
