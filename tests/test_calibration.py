"""Calibration measures and maps against known distortions and numpy."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vintara import Settings
from vintara.functions.splines import Spline
from vintara.operators import ablation, decision, recalibration, reliability
from vintara.operators.reliability import ProbabilityError

S = replace(Settings(), sweep_points=50)


def sample(rows=40_000, base=0.02, slope=1.0, shift=0.0, seed=11):
    rng = np.random.default_rng(seed)
    eta = np.log(base / (1 - base)) + 1.2 * rng.standard_normal(rows)
    observed = rng.random(rows) < 1 / (1 + np.exp(-eta))
    return 1 / (1 + np.exp(-(slope * eta + shift))), observed.astype(float)


@pytest.fixture(scope="module")
def distorted(spark):
    p, y = sample(slope=1.3, shift=0.5)
    frame = spark.createDataFrame(pd.DataFrame({"predicted": p, "observed": y})).withColumn("set", F.lit("a"))
    return frame.cache(), p, y


def test_reliability_matches_numpy(distorted):
    frame, p, y = distorted
    rows = {r["bin"]: r for r in reliability.reliability(frame, ["set"], S).collect()}
    edges = np.unique(np.quantile(p, np.linspace(0, 1, S.bins + 1)))
    index = np.clip(np.searchsorted(edges, p, side="right") - 1, 0, len(edges) - 2)
    assert sorted(rows) == sorted(set(index))
    for b, r in rows.items():
        inside = index == b
        assert r["rows"] == inside.sum() and r["events"] == y[inside].sum()
        assert r["mean_predicted"] == pytest.approx(p[inside].mean())


def test_murphy_terms_add_up_for_the_bin_means(distorted):
    frame, p, y = distorted
    row = reliability.population_scores(frame, ["set"], S).first()
    assert row["brier"] == pytest.approx(np.mean((p - y) ** 2))
    assert row["uncertainty"] == pytest.approx(y.mean() * (1 - y.mean()))
    assert abs(row["residual"]) < 0.1 * row["brier"]
    assert row["marginal_ratio"] == pytest.approx(p.sum() / y.sum())


def test_platt_undoes_a_known_distortion(distorted):
    frame, _, y = distorted
    fit = recalibration.fit_platt(frame, S)
    assert fit.slope == pytest.approx(1 / 1.3, rel=0.08)
    total = fit.apply(frame, "predicted", "c").agg(F.sum("c")).first()[0]
    assert total == pytest.approx(y.sum(), rel=1e-6)


def test_platt_converges_on_predictions_that_many_rows_share(spark):
    points = spark.range(200).select((F.col("id") * 0.02 - 5.0).alias("score"))
    rows = points.select(
        (1.0 / (1.0 + F.exp(-F.col("score")))).alias("predicted"), F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("copy")
    ).select("predicted", (F.col("copy") <= 1000 * F.sqrt("predicted")).cast("double").alias("observed"))
    fit = recalibration.fit_platt(rows, replace(S, max_iterations=20))
    back = fit.apply(rows, "predicted", "c")
    gap = F.col("c") - F.col("observed")
    plain, weighted = back.agg(F.sum(gap), F.sum(gap * F.ln(F.col("predicted") / (1.0 - F.col("predicted"))))).first()
    assert fit.converged and abs(plain) < 1e-6 and abs(weighted) < 1e-6


@pytest.mark.parametrize("observed, total", [([1.0, 1.0, 1.0], 3.0), ([0.0, 1.0, 1.0], 2.0)])
def test_platt_stands_samples_without_a_finite_optimum(spark, observed, total):
    rows = spark.createDataFrame(list(zip([0.1, 0.2, 0.3], observed)), "predicted double, observed double")
    fit = recalibration.fit_platt(rows, S)
    assert fit.apply(rows, "predicted", "c").agg(F.sum("c")).first()[0] == pytest.approx(total, abs=1e-3)


def test_platt_of_one_prediction_is_the_rate(spark):
    rows = spark.createDataFrame([(0.2, 1.0), (0.2, 0.0), (0.2, 0.0)], "predicted double, observed double")
    assert recalibration.fit_platt(rows, S).apply(rows, "predicted", "c").first()["c"] == pytest.approx(1 / 3)


def test_isotonic_is_monotone_and_capped(distorted):
    frame, _, y = distorted
    fit = recalibration.fit_isotonic(frame, S)
    mapped = fit.apply(frame, "predicted", "c").orderBy("predicted").toPandas()["c"].to_numpy()
    assert (np.diff(mapped) >= -1e-12).all() and mapped.max() <= fit.ceiling <= fit.uncapped
    free = recalibration.fit_isotonic(frame, replace(S, isotonic_tail_rows=0))
    total = free.apply(frame, "predicted", "c").agg(F.sum("c")).first()[0]
    assert total == pytest.approx(y.sum(), rel=1e-6)


def test_isotonic_tail_spike_is_rejected(spark):
    p = np.linspace(0.001, 0.01, 5000)
    y = (np.arange(5000) % 200 == 0).astype(float)
    y[-1] = 1.0
    frame = spark.createDataFrame(pd.DataFrame({"predicted": p, "observed": y}))
    fit = recalibration.fit_isotonic(frame, S)
    assert fit.uncapped == pytest.approx(1.0) and fit.ceiling < 0.1
    assert 0.0 < fit.clamped_share(frame, "predicted").first()[0] < 0.25


def test_bad_inputs_are_refused(spark, distorted):
    frame = distorted[0]
    for column, value in (("predicted", 1.5), ("predicted", float("nan")), ("observed", 0.5)):
        with pytest.raises(ProbabilityError):
            reliability.require_probabilities(frame.withColumn(column, F.lit(value)))
    with pytest.raises(ProbabilityError, match="no rows"):
        reliability.require_probabilities(frame.limit(0))
    with pytest.raises(ProbabilityError, match="no events"):
        recalibration.fit_platt(frame.withColumn("observed", F.lit(0.0)), S)


def applicants(spark, rows=2000, seed=5):
    rng = np.random.default_rng(seed)
    score = np.round(rng.beta(1.4, 18, rows), 3)
    bad = rng.random(rows) < score
    data = pd.DataFrame(
        {
            "loan_identifier": np.arange(rows), "score": score, "expected_npv": 1000 - 31000 * score,
            "realised_npv": np.where(bad, -30000.0, 1000 + rng.normal(0, 400, rows)),
            "resolved": rng.random(rows) < 0.9, "defaulted": bad,
        }
    )
    return spark.createDataFrame(data), data


def test_cutoff_curve_matches_a_plain_loop(spark):
    frame, data = applicants(spark)
    curve = decision.cutoff_curve(frame, S).orderBy("approved").toPandas()
    ordered = data.sort_values(["score", "loan_identifier"]).reset_index(drop=True)
    grid = np.unique(np.linspace(0, len(data), S.sweep_points + 1).astype(int))
    assert list(curve["approved"]) == list(grid)
    totals = np.concatenate([[0.0], ordered["realised_npv"].cumsum()])
    assert np.allclose(curve["npv_total"], totals[grid])
    ok, bad = ordered["resolved"], ordered["resolved"] & ordered["defaulted"]
    for k, accuracy, recall in zip(grid, curve["accuracy"], curve["recall"]):
        right = (ok & ~bad)[:k].sum() + bad[k:].sum()
        assert accuracy == pytest.approx(right / ok.sum())
        assert recall == pytest.approx(bad[k:].sum() / bad.sum())


def test_rules_are_bounded_by_hindsight(spark):
    frame, data = applicants(spark)
    rules = {r["rule"]: r for r in decision.evaluate(frame, S).rules.collect()}
    best = rules["oracle (hindsight)"]["npv_per_applicant"]
    assert all(r["npv_per_applicant"] <= best + 1e-9 for r in rules.values())
    assert rules["approve all"]["npv_per_applicant"] == pytest.approx(data["realised_npv"].mean())


def test_accuracy_threshold_matches_brute_force(spark):
    frame, data = applicants(spark)
    row = decision.accuracy_threshold(frame).first()
    known = data[data["resolved"]]
    scores = np.append(np.unique(known["score"]), 2.0)
    best = max(
        ((known["score"] < t) != known["defaulted"]).mean() for t in scores
    )
    # Cuts inside a tie can only do better than whole score levels.
    assert row["accuracy"] >= best - 1e-12
    assert ((known["score"] < row["threshold"]) != known["defaulted"]).mean() <= row["accuracy"] + 1e-12
    with pytest.raises(decision.NothingResolved):
        decision.accuracy_threshold(frame.withColumn("resolved", F.lit(False)))


def test_auc_matches_pair_counting(spark):
    frame, data = applicants(spark, rows=400)
    got = ablation.ranking_quality(frame.withColumn("arm", F.lit("x")), ["arm"]).first()["auc"]
    pos, neg = data[data.defaulted]["score"].to_numpy(), data[~data.defaulted]["score"].to_numpy()
    wins = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert got == pytest.approx(wins)


@pytest.mark.parametrize("knots", [(0.0, 1.0, 2.5, 4.0, 7.0), (0.0, 2.0, 5.0)])
def test_spline_basis_sums_to_one_and_extends_linearly(spark, knots):
    spline = Spline.at(knots)
    full = [t for t in spline.pieces()]
    assert all(np.allclose(table.sum(axis=0)[0], 1.0) for _, table in full)
    assert all(np.allclose(table.sum(axis=0)[1:], 0.0) for _, table in full)
    x = [-3.0, -2.0, -1.0, 0.0, 0.5, 2.5, knots[-1], knots[-1] + 1, knots[-1] + 2, knots[-1] + 3]
    frame = spark.createDataFrame([(v,) for v in x], "x double").coalesce(1)
    rows = frame.select(*[F.expr(c).alias(f"b{i}") for i, c in enumerate(spline.columns("x"))]).collect()
    table = np.array([list(r) for r in rows])
    assert table.shape[1] == spline.size == len(knots) + spline.degree - 2
    assert np.allclose(np.diff(table[:3], 2, axis=0), 0.0) and np.allclose(np.diff(table[-3:], 2, axis=0), 0.0)
    weights = np.arange(1.0, spline.size + 1)
    joint = [r[0] for r in frame.select(F.expr(spline.effect("x", weights))).collect()]
    assert np.allclose(joint, table @ weights)
