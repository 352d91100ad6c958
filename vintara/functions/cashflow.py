"""Amortisation and discounting as column expressions.

The contract rate is divided by twelve; the discount rate compounds. With both
conventions a loan discounted at its own note rate is worth exactly par.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_RATE = 1e-8


def monthly_discount(annual: Column) -> Column:
    return F.pow(1.0 + annual, F.lit(1.0 / 12.0)) - 1.0


def discount_factor(monthly: Column, months: Column) -> Column:
    return F.pow(1.0 + monthly, -months.cast("double"))


def monthly_payment(principal: Column, annual_note_rate: Column, term: Column) -> Column:
    """Level payment that repays ``principal`` over ``term`` months."""
    rate, months = annual_note_rate / 12.0, term.cast("double")
    level = F.try_divide(principal * rate, 1.0 - F.pow(1.0 + rate, -months))
    return F.when(F.abs(rate) <= ZERO_RATE, F.try_divide(principal, months)).otherwise(level)


def scheduled_balance(principal: Column, annual_note_rate: Column, term: Column, age: Column) -> Column:
    """Contractual balance entering month ``age``; zero from maturity on."""
    rate, months = annual_note_rate / 12.0, term.cast("double")
    elapsed = F.least(F.greatest(age.cast("double"), F.lit(0.0)), months)
    full = F.pow(1.0 + rate, months)
    share = F.try_divide(full - F.pow(1.0 + rate, elapsed), full - 1.0)
    straight = 1.0 - F.try_divide(elapsed, months)
    return principal * F.when(F.abs(rate) <= ZERO_RATE, straight).otherwise(share)


def recovery_multiple(
    monthly_rate: Column, lgd: Column | float, loss_probability: float, lag_months: int
) -> Column:
    """Present value at default of one unit of balance.

    The cured share keeps its balance; the rest recovers ``1 - lgd / q`` of it
    ``lag_months`` later.
    """
    severity = lgd / loss_probability
    delayed = discount_factor(monthly_rate, F.lit(lag_months))
    return (1.0 - loss_probability) + loss_probability * (1.0 - severity) * delayed
