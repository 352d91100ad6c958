"""The stages end to end, from text files to the ablation."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vintara.operators import model_store, reliability
from vintara.operators.hazard import HazardOverflow
from vintara.operators.valuation import LEGS, loan_npv, require_sound_paths
from vintara.operators import fold, projection
from vintara.plans import jobs, stored
from vintara.plans.queries import sources
from vintara.plans.queries.economics import rates_of
from vintara.sources import loan_files
from vintara.sources.driver_tables import DRIVER_SETTINGS as S
from vintara.sources.driver_tables import loan_book
from vintara.storage import fresh_path


@pytest.fixture(scope="module")
def reports():
    return {}


@pytest.fixture(scope="module")
def report(reports):
    return lambda name, table: reports.__setitem__(name, table.collect())


@pytest.fixture(scope="module")
def models(spark, folder, report):
    path = fresh_path(spark, "models")
    panel = stored.panel_of(spark, folder)
    fitted = jobs.fit_hazards(panel, S, report, S.holdout_share, path)
    loaded = model_store.load(spark, path, S)
    assert loaded.causes == fitted.causes
    assert all(loaded.causes[c].spec.names == m.spec.names for c, m in fitted.causes.items())
    return loaded


def test_ingest_types_and_audits(spark, folder):
    out = jobs.ingest(spark, sources.exported(spark, folder), S)
    lost = {(r["table"], r["column"]) for r in out["cast_losses"].collect()}
    assert lost == {("origination", "number_of_units"), ("performance", "loan_age")}
    assert out["origination"].count() == loan_book(spark, folder).count()
    assert dict(out["performance"].dtypes)["period_date"] == "date"


def test_missing_cohort_files_stop_the_job(spark, folder):
    wanted = S.__class__(train_cohorts=(1990,), test_cohorts=(1999,))
    with pytest.raises(loan_files.MissingFiles, match="1990"):
        jobs.ingest(spark, sources.exported(spark, folder), wanted)


def test_fit_reproduces_the_event_counts(models, reports):
    assert all(abs(m.marginal_gap) < 1e-6 for m in models.causes.values())
    rows = {r["loan_age"]: r for r in reports["hazard_fit_by_age"]}
    predicted = sum(r["predicted_default"] * r["at_risk"] for r in rows.values())
    assert predicted == pytest.approx(models.causes["default"].events, rel=1e-6)


def test_projected_hazards_equal_direct_scores(spark, folder, models):
    """Loan part plus age part gives the hazard the design matrix would give."""
    loans = projection.from_origination(projection.loan_terms(stored.panel_of(spark, folder), rates_of(spark, folder)))
    split = projection.projected_paths(loans, fold.model_hazards(models, S), S).select("loan_identifier", "loan_age", "hazard_default")
    months = loans.withColumn("loan_age", F.explode(F.sequence(F.lit(0), F.lit(S.horizon - 1))))
    direct = months.select("loan_identifier", "loan_age", models.causes["default"].probability().alias("p"))
    gap = split.join(direct, ["loan_identifier", "loan_age"]).agg(
        F.max(F.abs(F.col("hazard_default") - F.col("p"))), F.count(F.lit(1))
    ).first()
    assert gap[0] < 1e-12 and gap[1] == loans.count() * S.horizon


def test_calibrate_decide_and_ablate(spark, folder, models, report, reports):
    panel, book = stored.panel_of(spark, folder), loan_book(spark, folder)
    rates, months = rates_of(spark, folder), stored.months_of(spark, folder)
    # The fit on this small book projects one month whose hazards reach one: refused by default.
    with pytest.raises(HazardOverflow):
        jobs.calibrate(panel, models, rates, S, report)
    done = jobs.calibrate(panel, models, rates, S, report, strict=False)
    assert reports["survival_audit"][0]["overflows"] > 0
    scores = {(r["population"], r["variant"]): r for r in reports["calibration_scores"]}
    assert scores[reliability.TRAIN, "raw"]["marginal_ratio"] == pytest.approx(1.0, abs=1e-6)
    assert scores[reliability.HOLDOUT, "platt"]["marginal_ratio"] == pytest.approx(1.0, abs=1e-3)
    assert {r["scope"] for r in reports["calibration_npv"]} == set(projection.SCOPES)
    with pytest.raises(HazardOverflow):
        jobs.decide(panel, months, book, models, rates, S, report)
    jobs.decide(panel, months, book, models, rates, S, report, strict=False)
    spoiled = {r["variant"] for r in reports["calibration_npv"] if r["overflows"]}
    assert "raw" in spoiled
    assert [r["rule"] for r in sorted(reports["decision_rules"], key=lambda r: r["position"])][0] == "approve all"
    with pytest.raises(HazardOverflow):
        jobs.ablate(panel, months, book, models, rates, done, S, report)
    jobs.ablate(panel, months, book, models, rates, done, S, report, strict=False)
    arms = {r["arm"]: r for r in reports["ablation"]}
    assert list(sorted(arms)) == ["B0", "B1", "B2", "B3", "B4a", "B4b"]
    assert arms["B0"]["auc"] == pytest.approx(0.5) and arms["B0"]["approval_rate"] == 1.0
    for r in arms.values():
        if r["capture_cut"] is not None:
            assert r["capture_cut"] <= 1.0 + 1e-9


def test_model_fitted_under_other_settings_is_refused(spark, models):
    path = fresh_path(spark, "models")
    model_store.save(spark, models, path)
    from dataclasses import replace

    with pytest.raises(model_store.StaleModel):
        model_store.load(spark, path, replace(S, delinquency_threshold=2))
    # Economics do not change what a fit means.
    assert model_store.load(spark, path, replace(S, lgd=0.2)).causes


def test_values_from_two_tables_equal_values_from_one(spark, folder, models):
    loans = projection.from_origination(projection.loan_terms(stored.panel_of(spark, folder), rates_of(spark, folder)))
    paths = projection.projected_paths(loans, fold.model_hazards(models, S), S)
    require_sound_paths(paths, loans)
    apart = loan_npv(paths, loans, S).select("loan_identifier", F.col("npv").alias("a"))
    joint = projection.loan_values(loans, fold.model_hazards(models, S), S)
    row = joint.join(apart, "loan_identifier").agg(
        F.max(F.abs(F.col("npv") - F.col("a"))).alias("gap"),
        F.max(F.abs(F.col("npv") - sum(F.col(c) for c in LEGS) + F.col("principal"))).alias("legs"),
    ).first()
    assert row["gap"] < 1e-6 and row["legs"] < 1e-6


def test_files_in_subfolders_are_read_as_they_are_found(spark, tmp_path):
    """Discovery and scan use one listing: a file in a subfolder counts for both."""
    from vintara.settings import Settings
    from vintara.sources import loan_files, loan_schema

    columns = loan_schema.TABLES["origination"]
    line = "|".join("1" for _ in columns)
    for folder, year in (("", 2000), ("deep/", 2001)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / f"{folder}sample_orig_{year}.txt").write_text(line + "\n")
    settings = Settings(source="sample", train_cohorts=(2000,), test_cohorts=(2001,))
    found = {r[0] for r in loan_files.found_cohorts(spark, str(tmp_path), "origination", settings).collect()}
    read = {r[0] for r in loan_files.scan_cohorts(spark, str(tmp_path), "origination", settings).select("origination_vintage").collect()}
    assert found == read == {2000, 2001}


def test_rates_have_to_cover_every_cohort(spark):
    from vintara.operators.rates import UncoveredCohorts, require_rates
    from vintara.settings import Settings

    settings = Settings(train_cohorts=(2000,), test_cohorts=(2001,))
    full = spark.createDataFrame([(2000, 0.05), (2001, 0.06)], "vintage int, discount_rate double")
    require_rates(full, settings)
    for short in (full.where("vintage = 2000"), full.selectExpr("vintage", "case when vintage = 2000 then 0.05D end as discount_rate")):
        with pytest.raises(UncoveredCohorts):
            require_rates(short, settings)


def test_a_fit_that_hits_its_limit_says_so():
    from vintara.operators.hazard import reached
    from vintara.settings import Settings

    settings = Settings(max_iterations=3)
    assert reached(2, settings, "x")
    with pytest.warns(UserWarning, match="before it converged"):
        assert not reached(3, settings, "x")


def test_groups_without_a_name_keep_their_prefix_sums_and_quantiles(spark):
    from pyspark.sql import functions as F

    from vintara.operators.ordering import prefix_sums
    from vintara.operators.quantiles import exact_quantiles

    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, v double")
    sums = {(r["g"], r["v"]): r["t"] for r in prefix_sums(rows, ["g"], ["v"], t=F.col("v")).collect()}
    assert sums == {(None, 1.0): 1.0, (None, 3.0): 4.0, ("a", 2.0): 2.0}
    found = {r["g"]: r["quantiles"] for r in exact_quantiles(rows, ["g"], "v", [0.5]).collect()}
    assert found == {None: [2.0], "a": [2.0]}
