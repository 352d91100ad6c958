"""Values folded inside loan rows against plain loops and against month rows."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from vintara.functions.scalars import sigmoid
from vintara.operators import fold, panel, projection, valuation
from vintara.operators.recalibration import Isotonic, Platt
from vintara.plans import jobs
from vintara.sources import loan_files
from vintara.sources.driver_tables import DRIVER_SETTINGS
from vintara.storage import with_counts
from tests.loans import SETTINGS, origination, performance

S = replace(DRIVER_SETTINGS, horizon=18, binary_window=7, horizons=(3, 6, 18))
HAZARDS = fold.Hazards(
    lambda age: sigmoid(-4.0 + F.col("loan_identifier") / 10.0 + 0.05 * age), lambda age: sigmoid(-3.0 + 0.1 * age),
)


@pytest.fixture(scope="module")
def loans(spark):
    rows = [
        (n, 1998 + n % 3, 100_000.0 + 10_000 * n, (0.0, 5.0, 7.25)[n % 3], (360, 12, 180)[n % 3], 0.04 + 0.01 * (n % 3), 18, "default")
        for n in range(24)
    ]
    frame = spark.createDataFrame(
        rows, "loan_identifier long, origination_vintage int, original_upb double, original_interest_rate double, "
        "original_loan_term int, discount_rate double, exit_age int, exit_reason string",
    )
    return frame.withColumn("age", F.lit(3))


def _plain(row, calibrate=lambda p: p):
    import math

    squash = lambda x: 1 / (1 + math.exp(-x))
    upb, note, term = row["original_upb"], row["original_interest_rate"] / 1200, row["original_loan_term"]
    monthly = (1 + row["discount_rate"]) ** (1 / 12) - 1
    payment = upb / term if note == 0 else upb * note / (1 - (1 + note) ** -term)

    def balance(age):
        age = min(age, term)
        return upb * (1 - age / term if note == 0 else ((1 + note) ** term - (1 + note) ** age) / ((1 + note) ** term - 1))

    q = S.loss_probability
    recovery = 1 - q + q * (1 - S.lgd / q) * (1 + monthly) ** -S.recovery_lag
    alive, dead, score, value = 1.0, 0.0, None, -upb
    for age in range(S.horizon):
        d, p = calibrate(squash(-4.0 + row["loan_identifier"] / 10 + 0.05 * age)), squash(-3.0 + 0.1 * age)
        dead += alive * d
        score = dead if age == S.binary_window - 1 else score
        cash = (1 - d - p) * payment + p * balance(age) + d * balance(age) * recovery - S.servicing_bps / 120_000 * balance(age)
        if age == S.horizon - 1:
            cash += (1 - d - p) * balance(age + 1)
        value += alive * cash * (1 + monthly) ** -(age + 1)
        alive *= 1 - d - p
    return score, value


def test_lives_equal_a_plain_loop(loans):
    got = {r["loan_identifier"]: r for r in projection.loan_values(loans, HAZARDS, S).collect()}
    for row in loans.collect():
        score, value = _plain(row)
        assert got[row["loan_identifier"]]["score"] == pytest.approx(score, rel=1e-12)
        assert got[row["loan_identifier"]]["npv"] == pytest.approx(value, rel=1e-9, abs=1e-6)


def test_lives_need_no_exchange_order_or_month_rows(loans, capsys):
    projection.loan_values(loans, HAZARDS, S).explain()
    plan = capsys.readouterr().out
    assert not any(word in plan for word in ("Exchange", "Window", "Sort", "Generate"))


def test_arms_in_one_pass_equal_arms_one_by_one(loans):
    platt = Platt(0.8, 0.3)
    arms = {"a": (HAZARDS, None), "b": (HAZARDS, platt), "c": (fold.flat_hazards(F.lit(0.3), 0.02, S), None)}
    together = {r["loan_identifier"]: r for r in projection.arm_values(loans, arms, S).collect()}
    assert set(loans.columns) < set(together[0].asDict())
    for arm, (hazards, calibrator) in arms.items():
        for r in projection.loan_values(loans, hazards, S, calibrator).collect():
            same = together[r["loan_identifier"]]
            assert (same[f"score_{arm}"], same[f"expected_{arm}"]) == (r["score"], r["npv"])
    assert all(abs(r["score_c"] - 0.3) < 0.2 for r in together.values())


def test_portfolio_cells_equal_prices_of_month_rows(loans):
    variants = {"raw": None, "platt": Platt(0.8, 0.3), "sequential": Platt(1.0, 0.5)}
    paths = projection.variant_paths(loans, HAZARDS, variants, S).cache()
    table = projection.portfolio_npv(projection.portfolio_sums(paths, S), S, projection.scope_cells(S)).collect()
    assert {r["scope"] for r in table} == set(projection.SCOPES)
    for r in table:
        rows = paths.where(F.col("variant") == r["variant"])
        if r["scope"] != "headline":
            rows = rows.where(F.col("origination_vintage").isin(*S.test_cohorts[1:]))
        if r["scope"] == "sensitivity":
            rows = projection.sensitivity_sample(rows, S)
        shift = (r["discount_spread_bps"] - S.spread_bps) / 10_000.0
        book = valuation.price_paths(rows.withColumn("discount_rate", F.col("discount_rate") + shift), S, ["loan_identifier"], lgd=r["lgd"])
        total = book.agg(F.sum("npv"), F.count("*")).first()
        assert r["npv_total"] == pytest.approx(total[0], rel=1e-10) and r["loans"] == total[1]


def test_isotonic_expression_is_the_fitted_map(spark):
    rows = [(float(i) / 40, float((i * i) % 7 > 2), 1.0 + i % 3) for i in range(41)]
    frame = spark.createDataFrame(rows, "feature double, label double, weight double")
    for data in (frame, frame.where("feature = 0.5")):
        model = IsotonicRegression(featuresCol="feature", labelCol="label", weightCol="weight").fit(data)
        points = spark.createDataFrame([(-0.2 + i / 300,) for i in range(420)] + [(k,) for k in model.boundaries.toArray().tolist()], "feature double")
        both = model.transform(points).withColumn("mine", Isotonic(model, None, 1.0).column(F.col("feature")))
        assert both.agg(F.max(F.abs(F.col("prediction") - F.col("mine")))).first()[0] < 1e-12
        capped = points.select(Isotonic(model, 0.25, 1.0).column(F.col("feature")).alias("p"))
        assert capped.agg(F.max("p")).first()[0] <= 0.25


def test_counts_are_those_of_the_rows_written(spark, tmp_path):
    rows, seen = with_counts(spark.range(100).where("id % 3 = 0"), {"n": F.count("*"), "top": F.max("id")})
    rows.where("id > 10").write.parquet(str(tmp_path / "rows"))
    assert seen() == {"n": 34, "top": 99}


def test_cast_losses_come_with_the_typed_rows(spark, tmp_path):
    from vintara.sources.loan_schema import TABLES

    columns = list(TABLES["performance"])
    raw = spark.createDataFrame([tuple("x" if c == "loan_age" else None for c in columns), tuple("1" if c == "loan_age" else None for c in columns)], ", ".join(f"{c} string" for c in columns))
    rows, lost = loan_files.typed_and_losses(raw, columns)
    rows.write.parquet(str(tmp_path / "typed"))
    assert lost() == {"loan_age": 1} == {r["column"]: r["lost"] for r in loan_files.cast_losses(raw, "performance", columns).collect()}


def test_a_panel_that_lost_rows_is_refused(spark, tmp_path, monkeypatch):
    months, book = performance(spark), origination(spark)
    kept = jobs.build_panel(months, book, SETTINGS, str(tmp_path / "whole"), lambda *_: None)
    assert kept.count() > 0
    whole = panel.build_panel
    monkeypatch.setattr(panel, "build_panel", lambda *a: whole(*a).where("loan_age <> 3"))
    with pytest.raises(jobs.FaultyWrite):
        jobs.build_panel(months, book, SETTINGS, str(tmp_path / "lossy"), lambda *_: None)
