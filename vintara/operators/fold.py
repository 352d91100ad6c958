"""A loan's projected life as one expression over its row.

Ages are elements of an array, so survival, incidence and all cash-flow legs are carried from month to month by a fold: nothing is
exploded, sorted or exchanged, and a loan with any number of variants stays one row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintara.functions.cashflow import (
    discount_factor, monthly_discount, monthly_payment, recovery_multiple, scheduled_balance,
)
from vintara.functions.scalars import flat_monthly_hazard, sigmoid
from vintara.operators.hazard import HazardModels
from vintara.operators.recalibration import Calibrator
from vintara.operators.valuation import LEGS, checked_lgd, leg_amounts
from vintara.settings import Settings


@dataclass(frozen=True)
class Hazards:
    """Monthly hazards of a loan as functions of its age; ``inputs`` are loan columns they read, worked out once per loan."""

    default: Callable[[Column], Column]
    prepayment: Callable[[Column], Column]
    inputs: dict[str, Column] = field(default_factory=dict)


def model_hazards(models: HazardModels, settings: Settings) -> Hazards:
    """Hazards of fitted models: loan part per loan, age part from a table of one value per age."""
    inputs, tables = {}, {}
    for cause, model in models.causes.items():
        loan, _ = model.predictor_parts()
        inputs[f"_eta_{cause}"], tables[cause] = loan, model.age_effects(settings.horizon)

    def of(cause: str) -> Callable[[Column], Column]:
        return lambda age: sigmoid(F.col(f"_eta_{cause}") + F.get(tables[cause], age))

    return Hazards(of("default"), of("prepayment"), inputs)


def flat_hazards(probability: Column, prepayment_rate: float, settings: Settings) -> Hazards:
    """The constant hazard that reaches ``probability`` over the binary window."""
    return Hazards(
        lambda age: F.col("_flat"), lambda age: F.lit(float(prepayment_rate)),
        {"_flat": flat_monthly_hazard(probability, settings.binary_window)},
    )


def months_of(hazards: Hazards, settings: Settings) -> Column:
    """The hazards of every projected month, as an array of (age, default, prepaid)."""
    ages = F.sequence(F.lit(0), F.lit(settings.horizon - 1))
    return F.transform(
        ages,
        lambda age: F.struct(
            age.alias("age"), hazards.default(age).alias("default"), hazards.prepayment(age).alias("prepaid")
        ),
    )


def calibrated(months: Column, calibrator: Calibrator | None) -> Column:
    """The months with their default hazard recalibrated: the change moves the weight of every later month too."""
    if calibrator is None:
        return months
    return F.transform(
        months,
        lambda m: F.struct(m["age"], calibrator.column(m["default"]).alias("default"), m["prepaid"]),
    )


def path(months: Column) -> Column:
    """Survival and incidence of every month, under the names of path rows."""
    first = F.struct(
        F.lit(1.0).alias("survival"), F.lit(0.0).alias("cif_default"), F.lit(0.0).alias("cif_prepayment"),
        F.array().cast(
            "array<struct<loan_age:int,hazard_default:double,hazard_prepayment:double,survival:double,"
            "survival_entering:double,cif_default:double,cif_prepayment:double>>"
        ).alias("rows"),
    )

    def step(before: Column, m: Column) -> Column:
        entering = before["survival"]
        after = entering * (1.0 - m["default"] - m["prepaid"])
        dead = before["cif_default"] + entering * m["default"]
        gone = before["cif_prepayment"] + entering * m["prepaid"]
        row = F.struct(
            m["age"].alias("loan_age"), m["default"].alias("hazard_default"), m["prepaid"].alias("hazard_prepayment"),
            after.alias("survival"), entering.alias("survival_entering"), dead.alias("cif_default"),
            gone.alias("cif_prepayment"),
        )
        return F.struct(
            after.alias("survival"), dead.alias("cif_default"), gone.alias("cif_prepayment"),
            F.concat(before["rows"], F.array(row)).alias("rows"),
        )

    return F.aggregate(months, first, step)["rows"]


def life(
    months: Column, settings: Settings, *, lgd: float | None = None, loss_probability: float | None = None,
    recovery_lag: int | None = None, servicing_bps: float | None = None,
) -> Column:
    """Everything a loan's months add up to: the window score, the legs, and how many months' hazards reach one."""
    q = settings.loss_probability if loss_probability is None else loss_probability
    lag = settings.recovery_lag if recovery_lag is None else recovery_lag
    bps = settings.servicing_bps if servicing_bps is None else servicing_bps
    upb, term, note = F.col("original_upb"), F.col("original_loan_term"), F.col("original_interest_rate") / 100.0
    monthly = monthly_discount(F.col("discount_rate"))
    # Per month once, before the fold: what the fold reads more than once.
    priced = F.transform(
        months,
        lambda m: F.struct(
            m["age"], m["default"], m["prepaid"], discount_factor(monthly, m["age"] + 1).alias("discount"),
            scheduled_balance(upb, note, term, m["age"]).alias("balance"),
            scheduled_balance(upb, note, term, m["age"] + 1).alias("owed"),
        ),
    )
    constants = F.struct(
        monthly_payment(upb, note, term).alias("payment"),
        recovery_multiple(monthly, checked_lgd(settings, lgd, q), q, lag).alias("recovery"),
    )
    zero = [F.lit(0.0).alias(leg) for leg in LEGS]
    first = F.struct(
        F.lit(1.0).alias("survival"), F.lit(0.0).alias("cif_default"), F.lit(None).cast("double").alias("score"),
        F.lit(0).alias("overflows"), *zero, constants.alias("fixed"),
    )
    last, window = settings.horizon - 1, settings.binary_window - 1

    def step(so_far: Column, m: Column) -> Column:
        entering, stays = so_far["survival"], 1.0 - (m["default"] + m["prepaid"])
        dead = so_far["cif_default"] + entering * m["default"]
        amounts = leg_amounts(
            entering * m["discount"], m["default"], m["prepaid"], m["balance"], m["owed"], so_far["fixed"]["payment"],
            so_far["fixed"]["recovery"], bps,
        )
        ending = amounts.pop("ending_balance")
        legs = {leg: so_far[leg] + amount for leg, amount in amounts.items()}
        legs["terminal_leg"] = F.when(m["age"] == last, ending).otherwise(so_far["terminal_leg"])
        return F.struct(
            (entering * stays).alias("survival"), dead.alias("cif_default"),
            F.when(m["age"] == window, dead).otherwise(so_far["score"]).alias("score"),
            (so_far["overflows"] + F.when(m["default"] + m["prepaid"] >= 1.0, 1).otherwise(0)).alias("overflows"),
            *[legs[leg].alias(leg) for leg in LEGS], so_far["fixed"].alias("fixed"),
        )

    return F.aggregate(priced, first, step)


def loan_lives(
    loans: DataFrame, arms: dict[str, tuple[Hazards, Calibrator | None]], settings: Settings, **overrides
) -> DataFrame:
    """The loans with one struct column per arm: score, legs, principal, npv and overflows.

    Hazards that several arms share are worked out once per loan.
    """
    shared = {id(h): h for h, _ in arms.values()}
    inputs = {name: column for h in shared.values() for name, column in h.inputs.items()}
    rows = loans.withColumns(inputs) if inputs else loans
    rows = rows.withColumns({f"_months_{n}": months_of(h, settings) for n, h in enumerate(shared.values())})
    place = {key: n for n, key in enumerate(shared)}
    lives = {
        arm: life(calibrated(F.col(f"_months_{place[id(h)]}"), calibrator), settings, **overrides)
        for arm, (h, calibrator) in arms.items()
    }
    kept = [F.col(f"`{c}`") for c in loans.columns]
    folded = rows.select(*kept, *[c.alias(f"_life_{arm}") for arm, c in lives.items()])

    def valued(arm: str) -> Column:
        got, principal = F.col(f"_life_{arm}"), F.col("original_upb")
        npv = -principal
        for leg in LEGS:
            npv = npv + got[leg]
        return F.struct(
            got["score"].alias("score"), *[got[leg].alias(leg) for leg in LEGS], principal.alias("principal"),
            npv.alias("npv"), F.try_divide(npv, principal).alias("npv_per_dollar"), got["overflows"].alias("overflows"),
        ).alias(arm)

    return folded.select(*kept, *[valued(arm) for arm in lives])
