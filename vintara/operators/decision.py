"""Approval rules judged by the profit of the book they approve."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.functions.scalars import defaulted_by, ratio, resolved_by
from vintara.operators.hazard import LOAN
from vintara.operators.ordering import numbered, prefix_sums
from vintara.settings import Settings
from vintara.storage import durable

# Rules in table order.
RULES = ("approve all", "accuracy-max", "F1-max", "expected NPV > 0", "oracle (hindsight)")


class NothingResolved(ValueError):
    """No resolved loan to choose a threshold on."""


def applicants(
    scored: DataFrame, realised: DataFrame, outcomes: DataFrame, settings: Settings
) -> DataFrame:
    """One row per loan valued on both sides: score, expected and realised NPV, outcome."""
    window = settings.binary_window
    paid = realised.select(*LOAN, F.col("npv").alias("realised_npv"))
    left = outcomes.select(*LOAN, "exit_age", "exit_reason")
    return (
        scored.join(paid, list(LOAN)).join(left, list(LOAN), "left")
        .withColumns({"resolved": resolved_by(window), "defaulted": defaulted_by(window)})
    )


def _grid_point(index: Column, applicants_count: int, points: int) -> Column:
    """Approval count at grid index: evenly spaced from none to all, truncated."""
    step = applicants_count / points
    return F.when(index >= points, F.lit(applicants_count)).otherwise(
        (index * F.lit(step)).cast("bigint")
    )


def cutoff_curve(frame: DataFrame, settings: Settings) -> DataFrame:
    """What each approval count earns and how it classifies, on an even grid.

    Rows are ranked by (score, loan) without a global window; each falls into the
    grid interval that first includes it, and only grid rows are accumulated.
    """
    points = settings.sweep_points
    known = F.coalesce("resolved", F.lit(False))
    slim = frame.select(
        "score", "loan_identifier", "realised_npv", known.alias("resolved"),
        (known & F.col("defaulted")).alias("defaulted"),
    )
    ranked, total = numbered(slim, ["score", "loan_identifier"])
    step = max(total, 1) / points
    near = F.ceil(F.col("position") / F.lit(step)).cast("int")
    reaches = lambda i: _grid_point(i, total, points) >= F.col("position")
    index = F.when(reaches(near - 1), near - 1).when(reaches(near), near).otherwise(near + 1)
    buckets = ranked.groupBy(index.alias("_i")).agg(
        F.sum("realised_npv").alias("_npv"),
        F.count_if("resolved").alias("_resolved"),
        F.count_if("defaulted").alias("_defaulted"),
        F.max("score").alias("_score"),
    )
    spine = (
        frame.sparkSession.range(0, points + 1)
        .select(_grid_point(F.col("id"), total, points).alias("approved"), F.col("id").cast("int").alias("_i"))
        .groupBy("approved").agg(F.min("_i").alias("_i"))
    )
    # At most points + 1 rows from here on.
    grid = spine.join(buckets, "_i", "left")
    so_far = Window.orderBy("approved").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everyone = Window.partitionBy()
    run = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0))
    grid = grid.withColumns(
        {
            "npv_total": F.coalesce(F.sum("_npv").over(so_far), F.lit(0.0)),
            "_ok": run("_resolved"), "_bad": run("_defaulted"),
            "_all_ok": F.coalesce(F.sum("_resolved").over(everyone), F.lit(0)),
            "_all_bad": F.coalesce(F.sum("_defaulted").over(everyone), F.lit(0)),
        }
    )
    caught, declined = F.col("_all_bad") - F.col("_bad"), F.col("_all_ok") - F.col("_ok")
    zero = F.lit(0.0)
    grid = grid.withColumns(
        {
            "approval_rate": ratio(F.col("approved"), F.lit(total)),
            "threshold": F.when(F.col("approved") > 0, F.col("_score")).otherwise(0.0),
            "npv_per_applicant": F.try_divide("npv_total", F.lit(float(total))),
            "accuracy": ratio(F.col("_ok") - F.col("_bad") + caught, F.col("_all_ok")),
            "precision": F.coalesce(ratio(caught, declined), zero),
            "recall": F.coalesce(ratio(caught, F.col("_all_bad")), zero),
        }
    )
    both = F.col("precision") + F.col("recall")
    harmonic = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), both), zero)
    return grid.select(
        "approved", "approval_rate", "threshold", "npv_total", "npv_per_applicant", "accuracy",
        "precision", "recall", harmonic.alias("f1"),
    )


def rule_table(frame: DataFrame, curve: DataFrame, chooser: DataFrame | None = None) -> DataFrame:
    """Where each rule lands on the curve, and what the book earns there.

    Statistical cutoffs are chosen on ``chooser`` (the in-time holdout) and carried
    over as a score. The value rule carries over its approval *count*, read as a
    prefix of the risk ranking. All inputs but the frame have a few hundred rows.
    """
    picking = chooser if chooser is not None else curve

    def best(table: DataFrame, metric: str, value: str):
        # The first maximum wins.
        top = F.max_by(value, F.struct(F.col(metric), -F.col("approved")))
        return table.agg(top.alias("at")).first()["at"]

    def first_reaching(column: str, target) -> Column:
        # First grid row at or past the target; the last row if none reaches it.
        reached = F.min(F.when(F.col(column) >= F.lit(target), F.col("approved")))
        return F.coalesce(reached, F.max("approved"))

    positive = frame.agg(F.count_if(F.col("expected_npv") > 0).alias("at")).first()["at"]
    places = [
        F.max("approved"),
        first_reaching("threshold", best(picking, "accuracy", "threshold")),
        first_reaching("threshold", best(picking, "f1", "threshold")),
        first_reaching("approved", positive),
        F.max_by("approved", F.struct(F.col("npv_per_applicant"), -F.col("approved"))),
    ]
    rules = [
        F.struct(F.lit(i).alias("position"), F.lit(rule).alias("rule"), place.alias("approved"))
        for i, (rule, place) in enumerate(zip(RULES, places))
    ]
    rows = curve.agg(F.array(*rules).alias("_rules")).select(F.inline("_rules"))
    return curve.join(F.broadcast(rows), "approved").select(
        "position", "rule", "approval_rate", "threshold", "npv_per_applicant", "accuracy", "f1"
    )


@dataclass(frozen=True)
class Decision:
    frame: DataFrame
    curve: DataFrame
    rules: DataFrame


def evaluate(frame: DataFrame, settings: Settings, chooser: DataFrame | None = None) -> Decision:
    """Sweep the cutoff and locate every rule; the curves hold a few hundred rows."""
    curve, picked = durable(cutoff_curve(frame, settings)), None
    if chooser is not None and settings.choose_on_holdout:
        picked = durable(cutoff_curve(chooser, settings))
    return Decision(frame, curve, rule_table(frame, curve, picked))


def accuracy_threshold(frame: DataFrame) -> DataFrame:
    """The score cutoff with the best accuracy on resolved loans, and that accuracy.

    Used as "approve below the threshold". The first best count wins, including zero.
    """
    known = frame.where("resolved").select("score", "loan_identifier", "defaulted")
    gain = F.when(F.col("defaulted"), F.lit(-1)).otherwise(F.lit(1)).cast("long")
    steps = prefix_sums(
        known, [], ["score", "loan_identifier"], rank=F.lit(1).cast("long"), gain=gain
    )
    # Two reductions over the ranked rows: the best count, then the score just past it.
    best = steps.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("defaulted").alias("defaults"),
        F.max_by(F.struct("rank", "gain"), F.struct(F.col("gain"), -F.col("rank"))).alias("top"),
    ).first()
    if not best["total"]:
        raise NothingResolved("no resolved loan to choose a threshold on")
    count, gained = (best["top"]["rank"], best["top"]["gain"]) if best["top"]["gain"] > 0 else (0, 0)
    accuracy = (best["defaults"] + gained) / best["total"]
    if count >= best["total"]:
        edge = steps.agg(F.max("score").alias("score"))
        above = F.expr("cast(java_method('java.lang.Math', 'nextUp', score) AS double)")
    else:
        edge = steps.where(F.col("rank") == count + 1).select("score")
        above = F.col("score")
    return edge.select(above.alias("threshold"), F.lit(accuracy).alias("accuracy"))
