"""Comparing decision arms on one population, and where the model fails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.functions.scalars import ratio
from vintara.operators.hazard import LOAN
from vintara.operators.ordering import prefix_sums
from vintara.operators.quantiles import (
    distinct_edges, even_steps, exact_quantiles, right_closed_bin,
)
from vintara.operators.reliability import calibration_errors, reliability_parts
from vintara.settings import Settings
from vintara.storage import durable
from vintara.together import together

# Arms in table order with their labels.
ARMS = {
    "B0": "approve all",
    "B1": "binary 36m, accuracy-max",
    "B2": "binary 36m, profit-max",
    "B3": "hazard, profit-max",
    "B4a": "hazard + in-time recalibration",
    "B4b": "hazard + sequential recalibration",
}


def common_population(values: DataFrame, paid: DataFrame, arms: Sequence[str]) -> DataFrame:
    """One row per loan valued by every arm and realised: outcome, ``score_<arm>`` and ``expected_<arm>``."""
    columns = [f"{name}_{arm}" for arm in arms for name in ("score", "expected")]
    return values.select(*LOAN, "resolved", "defaulted", *columns).join(paid, list(LOAN))


def arm_rows(
    detail: DataFrame, accuracy_cutoff: float, base_rate: float, variants: Sequence[str] = ("B3", "B4a", "B4b")
) -> DataFrame:
    """The wide population as (loan, arm) rows with approval and ranking quantities."""

    def arm(key, approved, score, expected, decision, threshold) -> Column:
        return F.struct(
            F.lit(key).alias("arm"), approved.alias("approved"), score.alias("score"),
            expected.alias("expected"), decision.alias("decision_value"),
            threshold.cast("double").alias("threshold"),
        )

    binary, flat = F.col("score_B2"), F.col("expected_B2")
    none = F.lit(None).cast("double")
    arms = [
        arm("B0", F.lit(True), F.lit(base_rate), F.lit(0.0), F.lit(0.0), F.lit(1.0)),
        arm("B1", binary < accuracy_cutoff, binary, flat, -binary, F.lit(accuracy_cutoff)),
        arm("B2", flat > 0.0, binary, flat, flat, none),
    ]
    for key in variants:
        value = F.col(f"expected_{key}")
        arms.append(arm(key, value > 0.0, F.col(f"score_{key}"), value, value, none))
    return detail.select(*LOAN, "realised", "defaulted", "resolved", F.inline(F.array(*arms)))


def best_prefixes(rows: DataFrame, groups: Sequence[str], order: Sequence[Column | str], value: str) -> DataFrame:
    """Largest running total of ``value`` along an order, per group; zero if none is positive."""
    running = prefix_sums(
        rows.select(*groups, *[c for c in order if isinstance(c, str)], value), groups, order,
        _run=F.col(value),
    )
    return running.groupBy(*groups).agg(
        F.greatest(F.max("_run"), F.lit(0.0)).alias("best"), F.count(F.lit(1)).alias("size")
    )


def ranking_quality(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """AUC with ties at one half, and Gini, per group.

    Rows collapse to (group, score) counts first; the count of negatives below each
    score comes from prefix sums, never from pairs.
    """
    groups = list(groups)
    bad = F.col("defaulted")
    counts = rows.groupBy(*groups, "score").agg(
        F.count_if(bad).alias("_pos"), F.count_if(~bad).alias("_neg")
    )
    running = prefix_sums(counts, groups, ["score"], _below=F.col("_neg"))
    wins = F.col("_pos") * (F.col("_below") - F.col("_neg") + 0.5 * F.col("_neg"))
    table = running.groupBy(*groups).agg(
        F.sum(wins).alias("_wins"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n")
    )
    auc = F.try_divide("_wins", F.col("_p").cast("double") * F.col("_n"))
    return table.select(*groups, auc.alias("auc"), (2.0 * auc - 1.0).alias("gini"))


def score_metrics(rows: DataFrame, groups: Sequence[str], settings: Settings) -> DataFrame:
    """Discrimination and calibration of scores on resolved loans; null without both outcomes."""
    groups = list(groups)
    known = rows.where("resolved")
    clipped = known.select(
        *groups, F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)).alias("predicted"),
        F.col("defaulted").cast("double").alias("observed"),
    )
    parts = reliability_parts(clipped, groups, settings.bins, "quantile")
    brier = parts.groupBy(*groups).agg((F.sum("sum_squared") / F.sum("rows")).alias("brier"))
    errors = calibration_errors(parts, groups).drop("max_error")
    table = ranking_quality(known, groups).join(brier, groups).join(errors, groups)
    both = F.col("auc").isNotNull()
    return table.withColumns(
        {"brier": F.when(both, F.col("brier")), "ece": F.when(both, F.col("ece"))}
    )


def arm_table(rows: DataFrame, settings: Settings) -> DataFrame:
    """One row per arm: profit, forecast, two oracles, and how well its score ranks."""
    rows = durable(rows)
    totals = rows.groupBy("arm").agg(
        F.count(F.lit(1)).alias("applicants"),
        F.avg(F.col("approved").cast("double")).alias("approval_rate"),
        F.max("threshold").alias("threshold"),
        F.avg(F.when(F.col("approved"), F.col("realised")).otherwise(0.0)).alias("realised"),
        F.avg(F.when(F.col("approved"), F.col("expected")).otherwise(0.0)).alias("expected"),
        F.avg("realised").alias("_floor"),
    )
    # Both oracles in one ordered pass: by risk, and by the quantity the arm thresholds.
    orders = F.array(
        F.struct(F.lit("rank").alias("oracle"), F.col("score").alias("_key")),
        F.struct(F.lit("cut").alias("oracle"), (-F.col("decision_value")).alias("_key")),
    )
    ranked = rows.select("arm", "loan_identifier", "realised", F.inline(orders))
    best, metrics = together(
        lambda: best_prefixes(ranked, ["arm", "oracle"], ["_key", "loan_identifier"], "realised"),
        lambda: score_metrics(rows, ["arm"], settings),
    )
    per = F.col("best") / F.col("size")
    oracles = best.groupBy("arm").agg(
        F.max(F.when(F.col("oracle") == "rank", per)).alias("oracle_rank"),
        F.max(F.when(F.col("oracle") == "cut", per)).alias("oracle_cut"),
    )

    def capture(oracle: str) -> Column:
        room = F.col(oracle) - F.col("_floor")
        return F.when(room > 1e-9, (F.col("realised") - F.col("_floor")) / room)

    position = F.array_position(F.array(*[F.lit(a) for a in ARMS]), F.col("arm"))
    label = F.element_at(F.array(*[F.lit(v) for v in ARMS.values()]), position.cast("int"))
    return (
        totals.join(oracles, "arm").join(metrics, "arm", "left")
        .withColumns(
            {
                "label": label,
                "position": position,
                "capture_rank": capture("oracle_rank"),
                "capture_cut": capture("oracle_cut"),
            }
        )
        .drop("_floor")
    )


def arm_steps(arms: DataFrame) -> DataFrame:
    """Gain of each arm over approve-all and over the arm before it (six rows)."""
    order = Window.orderBy("position")
    floor = F.max(F.when(F.col("arm") == "B0", F.col("realised"))).over(Window.partitionBy())
    return arms.withColumns(
        {
            "vs_floor": F.col("realised") - floor,
            "step": F.col("realised") - F.coalesce(F.lag("realised").over(order), F.col("realised")),
        }
    )


def _failure(rows: DataFrame, key: str, arm: str, with_score: bool) -> DataFrame:
    measures = [F.count(F.lit(1)).alias("loans")]
    if with_score:
        measures.append(F.avg(f"score_{arm}").alias("mean_score"))
    measures += [
        F.avg(f"expected_{arm}").alias("expected_npv"),
        F.avg("realised").alias("realised_npv"),
        F.avg(F.col("defaulted").cast("double")).alias("default_rate"),
    ]
    return rows.groupBy(key).agg(*measures).withColumn(
        "gap", F.col("expected_npv") - F.col("realised_npv")
    )


def failure_by_cohort(detail: DataFrame, arm: str = "B3") -> DataFrame:
    """Expected minus realised value per loan, by cohort."""
    return _failure(detail, "origination_vintage", arm, with_score=False)


def failure_by_risk(detail: DataFrame, arm: str = "B3", deciles: int = 10) -> DataFrame:
    """The same by the model's own risk decile (right-closed, tied edges merged)."""
    score = f"score_{arm}"
    cuts = exact_quantiles(detail, [], score, even_steps(deciles)).select(
        distinct_edges(F.col("quantiles")).alias("edges")
    ).first()["edges"]
    edges = F.array(*[F.lit(e) for e in cuts])
    placed = detail.withColumn("decile", right_closed_bin(F.col(score), edges, deciles + 1))
    return _failure(placed, "decile", arm, with_score=True)


def base_rate(detail: DataFrame) -> Column:
    return ratio(F.count_if(F.col("resolved") & F.col("defaulted")), F.count_if("resolved"))
