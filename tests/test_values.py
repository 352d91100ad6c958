"""Identities and directions of the cash-flow operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.loans import SETTINGS, origination, performance, replace
from vintara.functions.cashflow import monthly_payment, recovery_multiple, scheduled_balance
from vintara.functions.scalars import flat_monthly_hazard
from vintara.operators import hazard, panel, rates, realised, severity, valuation
from vintara.settings import SettingsError
from vintara.sources import yield_files

S = replace(SETTINGS, servicing_bps=0.0)
RATE = 6.0
PAR = (1 + RATE / 1200) ** 12 - 1
HORIZON = 24


def paths(spark, default, prepaid, months=HORIZON, loans=("A",)):
    rows = spark.createDataFrame([(n,) for n in loans], "loan_identifier string")
    rows = rows.withColumn("loan_age", F.explode(F.sequence(F.lit(0), F.lit(months - 1))))
    rows = rows.withColumns({"hazard_default": F.lit(default), "hazard_prepayment": F.lit(prepaid)})
    return hazard.survival_paths(rows, ("loan_identifier",))


def terms(spark, discount=PAR, rate=RATE, loans=("A",)):
    return spark.createDataFrame(
        [(n, 200_000.0, rate, 360, discount) for n in loans],
        "loan_identifier string, original_upb double, original_interest_rate double, "
        "original_loan_term int, discount_rate double",
    )


def value(spark, default=0.0, prepaid=0.0, settings=S, discount=PAR, **overrides):
    return valuation.loan_npv(paths(spark, default, prepaid), terms(spark, discount), settings, **overrides).first()["npv"]


def test_riskless_loan_at_its_own_rate_is_worth_par(spark):
    assert abs(value(spark)) < 1e-6
    assert abs(value(spark, prepaid=0.02)) > 0.0


def test_value_falls_in_every_bad_direction(spark):
    base = value(spark, 0.01, 0.01)
    assert value(spark, 0.02, 0.01) < base
    assert value(spark, 0.01, 0.01, lgd=0.3) < base
    assert value(spark, 0.01, 0.01, discount=PAR + 0.01) < base
    assert value(spark, 0.01, 0.01, recovery_lag=48) < base
    assert value(spark, 0.01, 0.01, servicing_bps=50.0) < base


def test_severity_above_loss_probability_is_refused(spark):
    with pytest.raises(SettingsError):
        value(spark, lgd=0.9)


def test_amortisation_closed_forms(spark):
    one = spark.range(1)
    p, n = F.lit(1000.0), F.lit(12)
    row = one.select(
        monthly_payment(p, F.lit(0.0), n).alias("flat"),
        scheduled_balance(p, F.lit(0.06), n, F.lit(0)).alias("start"),
        scheduled_balance(p, F.lit(0.06), n, F.lit(12)).alias("end"),
        scheduled_balance(p, F.lit(0.06), n, F.lit(50)).alias("after"),
        scheduled_balance(p, F.lit(0.0), n, F.lit(6)).alias("half"),
        recovery_multiple(F.lit(0.01), 0.2, 0.4, 0).alias("now"),
    ).first()
    assert row["flat"] == pytest.approx(1000 / 12) and row["start"] == pytest.approx(1000.0)
    assert row["end"] == row["after"] == pytest.approx(0.0) and row["half"] == pytest.approx(500.0)
    assert row["now"] == pytest.approx(0.8)


def test_broken_paths_are_refused(spark):
    good, known = paths(spark, 0.01, 0.01), terms(spark)
    valuation.require_sound_paths(good, known)
    broken = {
        "max_drift": (good.withColumn("hazard_default", F.lit(0.05)), known),
        "bad_starts": (good.where("loan_age > 0"), known),
        "orphan_rows": (good.withColumn("loan_identifier", F.lit("B")), known),
        "repeated_terms": (good, known.unionByName(known)),
        "repeated_ages": (good.unionByName(good), known),
    }
    for check, (p, t) in broken.items():
        with pytest.raises(valuation.PathError, match=check):
            valuation.require_sound_paths(p, t)


def test_gaps_and_overflowing_hazards_are_refused(spark):
    keys = ("loan_identifier",)
    with pytest.raises(hazard.PathGap):
        hazard.require_survivable(paths(spark, 0.01, 0.01).where("loan_age <> 5"), keys)
    with pytest.raises(hazard.HazardOverflow):
        hazard.require_survivable(paths(spark, 0.6, 0.5), keys)


def test_survival_does_not_depend_on_row_order(spark):
    rows = paths(spark, 0.02, 0.01, loans=("A", "B"))
    mixed = rows.drop("survival", "survival_entering", "cif_default", "cif_prepayment").orderBy(F.rand(3))
    again = hazard.survival_paths(mixed, ("loan_identifier",))
    key = lambda r: (r["loan_identifier"], r["loan_age"])
    assert [r["cif_default"] for r in sorted(rows.collect(), key=key)] == [
        r["cif_default"] for r in sorted(again.collect(), key=key)
    ]


def test_flat_hazard_reaches_the_window_probability(spark):
    row = spark.range(1).select(flat_monthly_hazard(F.lit(0.06), 36).alias("h")).first()
    assert 1 - (1 - row["h"]) ** 36 == pytest.approx(0.06)


@pytest.fixture(scope="module")
def book(spark):
    months, loans = performance(spark), origination(spark)
    return months, loans, spark.createDataFrame([(2000, 0.05), (2001, 0.06)], "vintage int, discount_rate double")


def test_realised_principal_telescopes_and_legs_sum(book):
    months, loans, cohort_rates = book
    legs = realised.legs_of(months, cohort_rates, SETTINGS)
    assert realised.telescoping_audit(legs).first()["largest_gap"] < 1e-6
    rows = realised.measure(months, loans, cohort_rates, SETTINGS)
    total = sum(F.col(c) for c in ("pv_interest", "pv_principal", "pv_terminal", "pv_loss", "pv_servicing"))
    assert rows.agg(F.max(F.abs(total - F.col("advanced_upb") - F.col("npv")))).first()[0] < 1e-9
    # Loan 9 enters late and is not valued; all others are.
    assert rows.count() == 24 and rows.where("loan_identifier LIKE '%-09'").count() == 0


def test_unfunded_loans_are_dropped_and_counted(book):
    months, loans, cohort_rates = book
    zeroed = months.withColumn(
        "current_actual_upb", F.when(F.col("loan_identifier") == "L2000-01", 0.0).otherwise(F.col("current_actual_upb"))
    )
    valued = realised.realised_npv(realised.legs_of(zeroed, cohort_rates, SETTINGS), loans)
    assert realised.portfolio_legs(valued).first()["unfunded"] == 1
    with pytest.raises(realised.MissingOrigination):
        realised.require_origination(
            realised.realised_npv(realised.legs_of(months, cohort_rates, SETTINGS), loans.where("origination_vintage = 2000"))
        )


def test_severity_counts_the_known_loss(book):
    months, loans, _ = book
    table = panel.build_panel(months, loans, SETTINGS)
    row = severity.severity(severity.default_outcomes(table, months, SETTINGS), SETTINGS).where("scope = 'all'").first()
    assert (row["reached_default"], row["reached_loss_disposition"]) == (8, 2)
    assert row["lgd_at_disposition"] == row["lgd_median"] == pytest.approx(0.4)


def test_yield_files(spark, tmp_path):
    path = tmp_path / "y.csv"
    path.write_text("observation_date,DGS10\n2000-01-03,6.0\n2000-01-04,.\n2000-01-05,7.0\n2001-02-01,5.0\n")
    monthly = yield_files.load_yields(spark, str(path), "DGS10")
    found = {str(r["month"]): r["yield_pct"] for r in monthly.collect()}
    assert found == {"2000-01-01": 6.5, "2001-02-01": 5.0}
    with pytest.raises(yield_files.WrongSeries):
        yield_files.load_yields(spark, str(path), "DGS30")
    bare = tmp_path / "bare.csv"
    bare.write_text("observation_date,DGS10\n2000-01-03,.\n2000-01-04,\n")
    with pytest.raises(yield_files.EmptySeries):
        yield_files.load_yields(spark, str(bare), "DGS10")
    benchmark = rates.benchmark_by_cohort(monthly)
    rates.require_covered(benchmark, SETTINGS)
    table = {r["vintage"]: r["discount_rate"] for r in rates.discount_rates(benchmark, SETTINGS).collect()}
    assert table == {2000: pytest.approx(0.075), 2001: pytest.approx(0.06)}
    with pytest.raises(rates.UncoveredCohorts, match="2002"):
        rates.require_covered(benchmark, replace(SETTINGS, test_cohorts=(2001, 2002)))
