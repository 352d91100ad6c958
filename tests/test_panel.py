from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.loans import COHORTS, EXPECTED, SETTINGS, by_loan, origination, performance, replace
from vintara.operators import curves, panel


@pytest.fixture(scope="module")
def built(spark):
    months, book = performance(spark).cache(), origination(spark).cache()
    table = panel.build_panel(months, book, SETTINGS).cache()
    return months, book, table, panel.build_exits(months, book, SETTINGS).cache()


def test_every_loan_leaves_as_expected(built):
    found = by_loan(built[3], "exit_age", "exit_reason", "off_clock")
    assert found == {f"L{c}-{i:02d}": e for c in COHORTS for i, e in EXPECTED.items()}


def test_off_clock_loans_are_out_of_the_panel_but_have_an_exit(spark, built):
    months, book, table, _ = built
    assert table.where("loan_identifier LIKE '%-10'").count() == 0
    kept = panel.build_panel(months, book, replace(SETTINGS, exclude_off_clock=False))
    assert kept.where("loan_identifier LIKE '%-10'").count() == 2


def test_events_fire_once_and_only_in_the_exit_month(built):
    table = built[2]
    assert table.where("default_event AND NOT is_exit_month").count() == 0
    fired = by_loan(
        table.groupBy("loan_identifier").agg(
            F.count_if("default_event").alias("d"), F.count_if("prepayment_event").alias("p")
        ), "d", "p",
    )
    for loan, (d, p) in fired.items():
        reason = EXPECTED[int(loan[-2:])][1]
        assert (d, p) == (int(reason == "default"), int(reason == "prepaid"))


def test_rows_run_without_holes_from_entry_to_exit(built):
    spans = built[2].groupBy("loan_identifier", "exit_age", "first_observed_age").agg(
        F.count(F.lit(1)).alias("n"), F.max("loan_age").alias("last"), F.count_distinct("loan_age").alias("ages")
    )
    for r in spans.collect():
        assert r["n"] == r["ages"] == r["exit_age"] - r["first_observed_age"] + 1
        assert r["last"] == r["exit_age"] <= SETTINGS.horizon


def test_report_agrees_with_the_panel(built):
    months, book, table, _ = built
    row = panel.panel_report(months, book, SETTINGS).first()
    assert row["reconciles"]
    assert row["rows"] == table.count()
    assert row["loans"] == table.select("loan_identifier").distinct().count() == 24
    assert row["events"] == table.where("default_event").count() == 8
    assert row["off_clock_loans"] == row["excluded_loans"] == 2
    assert row["left_truncated_loans"] == row["seasoned_loans"] == 2
    assert row["clock_reset_loans"] == 4 and row["month_gap_loans"] == 2
    assert row["credit_event_before_delinquency"] == 2


def test_report_counts_loans_missing_on_either_side(built):
    months, book, _, _ = built
    row = panel.panel_report(
        months.where("loan_identifier <> 'L2000-01'"), book.where("loan_identifier <> 'L2000-02'"), SETTINGS
    ).first()
    assert (row["loans_missing_performance"], row["loans_missing_origination"]) == (1, 1)
    assert row["reconciles"]


def test_termination_mode_ignores_delinquency(built):
    months, book, _, _ = built
    found = by_loan(panel.build_exits(months, book, replace(SETTINGS, default_mode="termination")), "exit_reason")
    assert found["L2000-02"] == ("data_censor",) and found["L2000-04"] == ("default",)


def test_curves_are_consistent(built):
    table = curves.cohort_curves(built[2], SETTINGS)
    worst = table.agg(
        F.max(F.abs(F.col("survival") + F.col("cif_default") + F.col("cif_prepay") - 1)).alias("identity"),
        F.min(F.col("km_default") - F.col("cif_default")).alias("bias"),
        F.max(F.abs(F.col("naive_default") + F.col("naive_prepay") + F.col("naive_censored")
                    + F.col("not_yet_exited_share") - 1)).alias("shares"),
    ).first()
    assert worst["identity"] < 1e-12 and worst["bias"] > -1e-12 and worst["shares"] < 1e-12
    sizes = {r["cohort_size"] for r in table.collect()}
    assert sizes == {12}
