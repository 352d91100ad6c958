"""Thirteen loans per cohort whose exit age and reason are known in advance."""

from __future__ import annotations

from dataclasses import replace

from vintara.settings import Settings

COHORTS = (2000, 2001)
SETTINGS = Settings(train_cohorts=(2000,), test_cohorts=(2001,), horizon=60, horizons=(12, 24, 36, 60))
PERFORMANCE = (
    "loan_identifier string, origination_vintage int, period string, period_date string, loan_age int, "
    "remaining_months_to_legal_maturity int, current_actual_upb double, current_interest_rate double, "
    "current_loan_delinquency_status string, zero_balance_code string, zero_balance_removal_upb double, "
    "actual_loss double"
)
ORIGINATION = (
    "loan_identifier string, origination_vintage int, classic_fico int, original_upb double, "
    "original_interest_rate double, original_loan_term int"
)
UPB, TERM = 200_000.0, 360

# index -> (exit age, exit reason, off clock)
EXPECTED = {
    1: (60, "administrative_censor", False),
    2: (12, "default", False),
    3: (20, "prepaid", False),
    4: (25, "default", False),
    5: (40, "data_censor", False),
    6: (15, "informative_exit", False),
    7: (30, "default", False),
    8: (60, "administrative_censor", False),
    9: (50, "data_censor", False),
    10: (0, "default", True),
    11: (29, "clock_reset_censor", False),
    12: (12, "default", False),
    13: (14, "month_gap_censor", False),
}


def _month(cohort: int, index: int) -> tuple[str, str]:
    year, month = cohort + index // 12, index % 12 + 1
    return f"{year}{month:02d}", f"{year}-{month:02d}-01"


def _rows(cohort: int):
    def history(loan, ages, start=0, status=None, remaining=None, closing=None, loss=None):
        for i, age in enumerate(ages):
            period, date = _month(cohort, start + i)
            code = closing[1] if closing and closing[0] == age else None
            yield (
                f"L{cohort}-{loan:02d}", cohort, period, date, age,
                remaining(age) if remaining else TERM - age, 0.0 if code else UPB,
                5.0 + 0.25 * loan, (status or {}).get(age, "00"), code, UPB if code else None,
                loss if code else None,
            )

    yield from history(1, range(71))
    yield from history(2, range(31), status={10: "01", 11: "02", 12: "03", 13: "04"})
    yield from history(3, range(21), closing=(20, "01"))
    yield from history(4, range(26), closing=(25, "03"), loss=0.4 * UPB)
    yield from history(5, range(41))
    yield from history(6, range(16), closing=(15, "16"))
    yield from history(7, range(36), status={30: "RA"})
    yield from history(8, range(71), status={65: "03"})
    yield from history(9, range(6, 51), start=6)
    yield from history(10, range(21), status=dict.fromkeys(range(21), "14"), remaining=lambda a: 60 - a)
    yield from history(11, range(30))
    yield from history(11, range(25), start=36, status={a: "03" for a in range(20, 25)}, remaining=lambda a: 480 - a)
    yield from history(12, range(40), status={a: "03" for a in range(12, 40)})
    yield from history(12, range(12), start=48, remaining=lambda a: 480 - a)
    yield from history(13, [a for a in range(30) if a != 15])


def performance(spark):
    rows = [r for c in COHORTS for r in _rows(c)]
    frame = spark.createDataFrame(rows, PERFORMANCE)
    return frame.withColumn("period_date", frame.period_date.cast("date"))


def origination(spark):
    rows = [
        (f"L{c}-{i:02d}", c, 600 + 20 * i, UPB, 5.0 + 0.25 * i, TERM) for c in COHORTS for i in EXPECTED
    ]
    return spark.createDataFrame(rows, ORIGINATION)


def by_loan(frame, *columns):
    return {r["loan_identifier"]: tuple(r[c] for c in columns) for r in frame.collect()}


__all__ = ["COHORTS", "EXPECTED", "SETTINGS", "by_loan", "origination", "performance", "replace"]
