from __future__ import annotations

import pytest

from vintara import Settings, SettingsError


def test_defaults_are_valid():
    s = Settings()
    assert s.cohorts[0] == 2000 and s.late_age == 90
    assert abs(s.severity_given_loss - 0.1330 / 0.3697) < 1e-12


@pytest.mark.parametrize(
    "change",
    [
        {"release": 46}, {"source": "other"}, {"default_mode": "delinqency"}, {"train_cohorts": ()},
        {"train_cohorts": (2006,)}, {"train_cohorts": (2007,), "test_cohorts": (2006,)},
        {"credit_event_codes": ()}, {"credit_event_codes": ("77",)}, {"credit_event_codes": ("01",)},
        {"credit_event_codes": ("15",)}, {"delinquency_threshold": 0}, {"age_knots": 2},
        {"tolerance": 0.1}, {"inverse_penalty": 0.0}, {"linear_columns": ("classic_fico",)},
        {"categorical_columns": ("classic_fico",)}, {"lgd": 0.5}, {"recovery_lag": -1},
        {"bins": 1}, {"binning": "odd"}, {"horizons": (24, 12)}, {"horizons": (12, 240)},
        {"holdout_share": 1.0}, {"methods": ("beta",)}, {"binary_window": 121}, {"sweep_points": 5},
        {"horizon": 0}, {"fixed_rate": -1.0}, {"spread_bps": 5000.0}, {"min_level_share": 1.0},
    ],
)
def test_contradictions_are_refused(change):
    with pytest.raises(SettingsError):
        Settings(**change)
