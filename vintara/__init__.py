"""Loan-panel survival, calibration and profit analytics as Spark DataFrame jobs."""

from vintara.settings import Settings, SettingsError

__all__ = ["Settings", "SettingsError"]
