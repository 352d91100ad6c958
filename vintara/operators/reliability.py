"""Calibration measurement, for many populations in one job.

Rows carry ``predicted`` and ``observed``; ``groups`` names the columns that
separate populations and variants. Everything after one grouped aggregate works
on at most (groups x bins) rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from vintara.functions.scalars import in_share
from vintara.operators.quantiles import (
    counted_quantiles, distinct_edges, even_steps, left_closed_bin,
)
from vintara.settings import Settings
from vintara.storage import durable, small_side

# Labels of the scored populations.
TRAIN, HOLDOUT, TEST = "train (in-sample)", "holdout (in-time)", "test (out-of-time)"


class ProbabilityError(ValueError):
    """Predictions or outcomes that would give meaningless scores."""


def probability_audit(rows: DataFrame) -> DataFrame:
    """Counts of the inputs that must not occur, and of all rows."""
    p, y = F.col("predicted").cast("double"), F.col("observed").cast("double")
    finite = p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~finite).alias("not_finite"),
        F.count_if(finite & ~p.between(0.0, 1.0)).alias("outside_unit"),
        F.count_if(y.isNull() | ~y.isin(0.0, 1.0)).alias("not_binary"),
        F.count_if(y == 1.0).alias("events"),
    )


def require_probabilities(rows: DataFrame, need_events: bool = False) -> Row:
    """The audit of the rows, which must hold."""
    found = probability_audit(rows).first()
    if not found["rows"]:
        raise ProbabilityError("no rows to calibrate")
    wrong = {n: found[n] for n in ("not_finite", "outside_unit", "not_binary") if found[n]}
    if wrong:
        raise ProbabilityError(f"bad calibration input: {wrong}")
    if need_events and not found["events"]:
        raise ProbabilityError("no events in the calibration sample")
    return found


def calibration_rows(
    scored: DataFrame, variants: dict[str, str], settings: Settings, sequential: str | None = None
) -> DataFrame:
    """Scored panel rows as (population, variant, predicted, observed).

    ``variants`` maps a variant to its probability column and includes ``raw``;
    ``sequential`` names the column recalibrated on the first test cohort, which is
    scored on the later ones. One pass; a row appears once per population it is in.
    """
    cohort = F.col("origination_vintage")
    held = in_share(F.col("loan_identifier"), settings.holdout_share, settings.holdout_seed)
    population = F.when(
        cohort.isin(*settings.train_cohorts), F.when(held, HOLDOUT).otherwise(TRAIN)
    ).when(cohort.isin(*settings.test_cohorts), TEST)

    def entry(where: Column, variant: str, column: str) -> Column:
        return F.struct(
            where.alias("population"), F.lit(variant).alias("variant"),
            F.col(column).alias("predicted"),
        )

    entries = F.array(*[entry(population, v, c) for v, c in variants.items()])
    first, *later = settings.test_cohorts
    if sequential and later:
        label = F.lit(f"test {', '.join(map(str, later))} (sequential)")
        extra = F.array(
            entry(label, "raw", variants["raw"]), entry(label, f"platt fitted on {first}", sequential)
        )
        entries = F.concat(entries, F.when(cohort.isin(*later), extra).otherwise(F.slice(extra, 1, 0)))
    return scored.select(
        "origination_vintage", "loan_identifier", F.col("default_event").cast("double").alias("observed"),
        F.inline(entries),
    ).where(F.col("population").isNotNull())


def tally(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Row and event counts per group and distinct prediction, materialised.

    The only pass over the scored rows: edges, bins and every score follow from it.
    """
    return durable(
        rows.groupBy(*groups, F.col("predicted").cast("double").alias("_v")).agg(
            F.count(F.lit(1)).alias("_n"), F.sum(F.col("observed").cast("double")).alias("_y")
        )
    )


def tally_edges(counts: DataFrame, groups: Sequence[str], bins: int, strategy: str) -> DataFrame:
    """Ascending distinct edges per group, as an array column ``edges``."""
    groups = list(groups)
    if strategy == "uniform":
        steps = F.array(*[F.lit(s) for s in even_steps(bins)])
        return counts.select(*groups).distinct().withColumn("edges", steps)
    quantiles = counted_quantiles(counts, groups, even_steps(bins))
    edges = quantiles.select(*groups, distinct_edges(F.col("quantiles")).alias("edges"))
    one = F.get("edges", F.lit(0))
    return edges.withColumn("edges", F.when(F.size("edges") < 2, F.array(one, one)).otherwise(F.col("edges")))


def bin_edges(rows: DataFrame, groups: Sequence[str], bins: int, strategy: str) -> DataFrame:
    return tally_edges(tally(rows, groups), groups, bins, strategy)


def reliability_parts(
    rows: DataFrame, groups: Sequence[str], bins: int, strategy: str = "quantile"
) -> DataFrame:
    """The reliability table plus the sums its summary scores need.

    ``groups`` names at least one label column.
    """
    groups = list(groups)
    counts = tally(rows, groups)
    # One row per population: broadcast behind a row-count check, so populations
    # of very different size never meet in a keyed shuffle.
    edges = small_side(tally_edges(counts, groups, bins, strategy))
    p, n, y = F.col("_v"), F.col("_n"), F.col("_y")
    table = (
        counts.join(edges, groups)
        .withColumn("bin", left_closed_bin(p, F.col("edges"), bins + 1))
        .groupBy(*groups, "bin")
        .agg(
            F.sum(n).alias("rows"),
            F.sum(y).cast("bigint").alias("events"),
            F.sum(p * n).alias("sum_predicted"),
            F.min(p).alias("min_predicted"),
            F.max(p).alias("max_predicted"),
            # (p - 0)^2 for the rows without the event, (p - 1)^2 for those with it.
            F.sum((n - y) * p * p + y * (p - 1.0) * (p - 1.0)).alias("sum_squared"),
            F.first("edges").alias("edges"),
        )
        .withColumns(
            {
                "mean_predicted": F.col("sum_predicted") / F.col("rows"),
                "observed_rate": F.col("events") / F.col("rows"),
            }
        )
    )
    mean = F.col("mean_predicted")
    return table.withColumns(
        {
            "bin_low": F.get("edges", F.col("bin")),
            "bin_high": F.get("edges", F.col("bin") + 1),
            # Under the predicted rate: a bin without events still has an error.
            "standard_error": F.sqrt(mean * (1.0 - mean) / F.col("rows")),
            "residual": F.col("observed_rate") - mean,
        }
    ).withColumn(
        "z", F.try_divide("residual", F.nullif(F.col("standard_error"), F.lit(0.0)))
    ).drop("edges")


def reliability(rows: DataFrame, groups: Sequence[str], settings: Settings) -> DataFrame:
    parts = reliability_parts(rows, groups, settings.bins, settings.binning)
    return parts.drop("sum_predicted", "sum_squared")


def _weighted(value: Column) -> Column:
    return F.sum(value * F.col("rows")) / F.sum("rows")


def calibration_errors(parts: DataFrame, groups: Sequence[str]) -> DataFrame:
    gap = F.abs(F.col("observed_rate") - F.col("mean_predicted"))
    return parts.groupBy(*groups).agg(
        _weighted(gap).alias("ece"), F.max(gap).alias("max_error")
    )


def brier_parts(parts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Brier score with its reliability, resolution and uncertainty terms."""
    groups = list(groups)
    n, events = F.sum("rows"), F.sum("events")
    # Resolution around the base rate, from per-bin sums: mean of squares minus square of mean.
    observed = F.col("observed_rate")
    base = events / n
    table = parts.groupBy(*groups).agg(
        n.alias("rows"),
        events.alias("observed_events"),
        F.sum("sum_predicted").alias("predicted_events"),
        (F.sum("sum_squared") / n).alias("brier"),
        _weighted(F.pow(F.col("mean_predicted") - observed, 2.0)).alias("reliability"),
        (_weighted(observed * observed) - base * base).alias("resolution"),
        F.count(F.lit(1)).alias("bins_used"),
    )
    rate = F.col("observed_events") / F.col("rows")
    explained = F.col("reliability") - F.col("resolution") + F.col("uncertainty")
    return table.withColumns({"base_rate": rate, "uncertainty": rate * (1.0 - rate)}).withColumns(
        {
            "residual": F.col("brier") - explained,
            "skill": F.when(
                F.col("uncertainty") > 0.0, 1.0 - F.try_divide("brier", "uncertainty")
            ).otherwise(0.0),
        }
    )


def population_scores(rows: DataFrame, groups: Sequence[str], settings: Settings) -> DataFrame:
    """One row per (population, variant): every calibration statistic, in one job."""
    groups = list(groups)
    parts = reliability_parts(rows, groups, settings.bins, settings.binning)
    return scores_from_parts(parts, groups)


def scores_from_parts(parts: DataFrame, groups: list[str]) -> DataFrame:
    scores = brier_parts(parts, groups).join(calibration_errors(parts, groups), groups)
    return scores.withColumn(
        "marginal_ratio",
        F.try_divide("predicted_events", F.nullif(F.col("observed_events").cast("double"), F.lit(0.0))),
    )


def with_sample_flag(scores: DataFrame) -> DataFrame:
    """Mark scores measured on rows their own fit has seen: controls, not results."""
    raw = F.col("variant") == "raw"
    return scores.withColumn(
        "in_sample_for_this_fit",
        (raw & (F.col("population") == TRAIN)) | (~raw & (F.col("population") == HOLDOUT)),
    )


def harness_checks(scores: DataFrame) -> DataFrame:
    """The invariants that decide whether the scores can be trusted, in one row."""

    def of(column: str, population: str, variant: str) -> Column:
        hit = (F.col("population") == population) & (F.col("variant") == variant)
        return F.max(F.when(hit, F.col(column)))

    def later(raw: bool) -> Column:
        is_raw = F.col("variant") == "raw"
        hit = F.contains("population", F.lit("sequential")) & (is_raw if raw else ~is_raw)
        return F.max(F.when(hit, F.col("marginal_ratio")))

    def closed(before: Column, after: Column) -> Column:
        gap = F.abs(before - 1.0)
        return F.try_divide(gap - F.abs(after - 1.0), gap)

    row = scores.agg(
        of("marginal_ratio", TRAIN, "raw").alias("in_sample_ratio"),
        of("marginal_ratio", TEST, "raw").alias("test_ratio"),
        of("ece", TEST, "raw").alias("test_ece"),
        *[of("marginal_ratio", TEST, m).alias(f"test_ratio_{m}") for m in ("platt", "isotonic")],
        later(True).alias("later_ratio_raw"),
        later(False).alias("later_ratio_sequential"),
    )
    test = F.col("test_ratio")
    return row.withColumns(
        {
            "in_sample_ok": F.abs(F.col("in_sample_ratio") - 1.0) < 0.01,
            "under_predicts_out_of_time": test < 1.0,
            "no_leakage": F.col("test_ece") > 0.0,
            "platt_gap_closed": closed(test, F.col("test_ratio_platt")),
            "isotonic_gap_closed": closed(test, F.col("test_ratio_isotonic")),
            "sequential_gap_closed": closed(
                F.col("later_ratio_raw"), F.col("later_ratio_sequential")
            ),
        }
    )
