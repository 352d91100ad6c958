"""Fits against an independent Newton solver, and the oracles of all model, calibration and decision queries."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, difference
from vintara.operators import hazard, newton as solver, selection
from vintara.operators.design import fit_spec, loans_with_months
from vintara.operators.newton import weighted_sums as newton_sums
from vintara.plans import catalog
from vintara.plans.queries import models as queries
from vintara.sources.driver_tables import DRIVER_SETTINGS as S

HEAVY = [n for n in catalog.oracle_sql() if n[0] in "fhbmkda"]


@pytest.mark.parametrize("name", HEAVY)
def test_queries_match_their_oracles(spark, folder, name):
    con = connect(folder)
    assert difference(catalog.queries()[name](spark, folder), con, catalog.oracle_sql()[name]) is None


def newton(x, y, penalty):
    """Plain penalised Newton steps with an unpenalised intercept; returns (intercept and slopes, log-likelihood)."""
    x = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([0.0] + [penalty] * (x.shape[1] - 1))
    b = np.zeros(x.shape[1])
    b[0] = math.log(y.mean() / (1.0 - y.mean()))

    def objective(b):
        eta = x @ b
        return (y * eta - np.logaddexp(0.0, eta)).sum() - 0.5 * b @ ridge @ b

    for _ in range(200):
        p = 1.0 / (1.0 + np.exp(-(x @ b)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ b)
        scale = 1.0
        while objective(b + scale * step) < objective(b) and scale > 1e-9:
            scale /= 2
        b = b + scale * step
        if np.abs(step).max() < 1e-10:
            break
    eta = x @ b
    return b, float((y * eta - np.logaddexp(0.0, eta)).sum())


def encoded(panel, spec):
    rows = hazard.design_matrix(panel, spec, {e: F.col(e) for e in hazard.EVENTS.values()}).collect()
    return np.array([r["features"].toArray() for r in rows]), {
        c: np.array([r[e] for r in rows]) for c, e in hazard.EVENTS.items()
    }


def test_hazard_fits_equal_an_independent_solver(spark, folder):
    fitted = queries.fitted(spark, folder)
    x, labels = encoded(queries.fitting_panel(spark, folder), fitted.causes["default"].spec)
    for cause, model in fitted.causes.items():
        b, _ = newton(x, labels[cause], 1.0 / S.inverse_penalty)
        varies = x.max(axis=0) > x.min(axis=0)
        assert np.allclose(np.array(model.coefficients)[varies], b[1:][varies], atol=0.02)
        assert np.abs(1 / (1 + np.exp(-(b[0] + x @ b[1:]))) - 1 / (1 + np.exp(-(model.intercept + x @ np.array(model.coefficients))))).max() < 1e-3


def test_knot_study_likelihoods_equal_an_independent_solver(spark, folder):
    panel = queries.training_panel(spark, folder)
    found = {r["knots"]: r for r in selection.knot_study(panel, S, knot_counts=(6, 9)).collect()}
    for knots, row in found.items():
        spec = fit_spec(loans_with_months(panel), replace(S, age_knots=knots))
        x, labels = encoded(panel, spec)
        _, likelihood = newton(x, labels["default"], 1.0 / S.inverse_penalty)
        assert row["log_likelihood"] == pytest.approx(likelihood, abs=0.01)
        assert row["bic_by_rows"] == pytest.approx(-2 * likelihood + row["parameters"] * math.log(len(x)), abs=0.05)


def test_knot_counts_share_their_passes(spark, folder, monkeypatch):
    calls, sums = [], solver._sums
    monkeypatch.setattr(solver, "_sums", lambda *a, **k: calls.append(1) or sums(*a, **k))
    panel = queries.training_panel(spark, folder)
    one = [tuple(r) for r in selection.knot_study(panel, S, knot_counts=(9,)).collect()]
    alone = len(calls)
    both = [tuple(r) for r in selection.knot_study(panel, S, knot_counts=(6, 9, 16)).collect()]
    assert len(calls) - alone < 2 * alone
    assert [r[0] for r in both] == [6, 9, 16] and both[1] == pytest.approx(one[0], rel=1e-9, abs=1e-9)


def test_months_of_a_loan_are_encoded_once_in_any_order(spark, folder):
    panel = queries.training_panel(spark, folder)
    spec = fit_spec(loans_with_months(panel), S)
    rows = panel.select(*spec.compact(), F.col("default_event").cast("double").alias("y"))
    batch = rows.coalesce(1).toArrow().combine_chunks().to_batches()[0]
    ages, loans = spec.factors()(batch)
    assert len(loans[0]) < 0.6 * batch.num_rows and len(ages[0]) <= S.horizon + 1
    assert np.array_equal(np.hstack([ages[0][ages[1]], loans[0][loans[1]]]), spec.encoder()(batch))
    width = len(spec.names)
    point = np.linspace(-0.5, 0.5, 1 + width)
    plain = solver.Problem(spec.encoder(), "y", 0.1, width)
    factored = solver.Problem(spec.factors(), "y", 0.1, width)
    expected, = solver._sums(rows, [plain], [point])
    for found in (*solver._sums(rows, [factored], [point]), *solver._sums(rows.orderBy(F.rand(3)), [factored], [point])):
        assert np.allclose(found, expected, rtol=1e-9, atol=1e-7)
    kept, = solver.varying(rows, [spec.factors()], [width])
    x = spec.encoder()(batch)
    assert kept == np.flatnonzero(x.min(axis=0) < x.max(axis=0)).tolist()


def test_a_wrong_model_breaks_its_score_equations(spark, folder):
    fitted = queries.fitted(spark, folder)
    shifted = replace(fitted.causes["default"], intercept=fitted.causes["default"].intercept + 0.1)
    panel = queries.fitting_panel(spark, folder)
    table = hazard.score_equations({"default": shifted}, hazard.EVENTS, panel, S)
    row = table.where("feature = 'intercept'").first()
    assert row["predicted"] > 1.05 * row["observed"]


def test_encoder_and_expressions_give_the_same_design(spark, folder):
    panel = queries.training_panel(spark, folder)
    # Values at and beyond the knots, nulls and levels that the fit does not know.
    edge = panel.limit(50).withColumns({
        "classic_fico": F.when(F.rand(1) < 0.3, 200).when(F.rand(2) < 0.3, 900).otherwise(F.col("classic_fico")),
        "channel": F.lit("unheard of"), "original_upb": F.lit(None).cast("double"),
    })
    spec = fit_spec(loans_with_months(panel), S)
    rows = panel.unionByName(edge)
    sums = newton_sums(rows.select(*spec.compact(), F.lit(1.0).alias("w"), F.col("loan_age").cast("double").alias("a")),
                       spec.encoder(), ["w", "a"], len(spec.names))
    wide = rows.select("loan_age", *[c.alias(f"f{i}") for i, c in enumerate(spec.columns())])
    for name, weight in (("w", F.lit(1.0)), ("a", F.col("loan_age"))):
        expected = wide.agg(*[F.sum(F.col(f"f{i}") * weight) for i in range(len(spec.names))]).first()
        assert np.allclose(sums[name][1:], list(expected), rtol=1e-9, atol=1e-9)


def test_fits_meet_their_score_equations_and_hold_no_wide_rows(spark, folder):
    fitted = queries.fitted(spark, folder)
    table = hazard.score_equations(fitted.causes, hazard.EVENTS, queries.fitting_panel(spark, folder), S)
    gaps = [abs(r["observed"] - r["predicted"] - r["penalty"]) for r in table.collect() if r["observed"]]
    assert max(gaps) < 1e-4
    panel = queries.fitting_panel(spark, folder)
    labels = {e: F.col(e) for e in hazard.EVENTS.values()}
    spec = fitted.causes["default"].spec
    with hazard.fitting_matrix(panel, loans_with_months(panel), spec, labels) as (held, _, _):
        assert len(held.columns) < len(spec.names) / 2
