"""Monotone recalibration of a predicted probability: Platt and isotonic."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintara.functions.scalars import logit, sigmoid
from vintara.operators.hazard import reached
from vintara.operators.newton import fit_logistic
from vintara.operators.reliability import require_probabilities
from vintara.settings import Settings
from vintara.together import together


class Calibrator(Protocol):
    name: str

    def column(self, probability: Column) -> Column: ...

    def apply(self, rows: DataFrame, source: str, target: str) -> DataFrame: ...


@dataclass(frozen=True)
class Platt:
    """A shift and a stretch of the log-odds; strictly monotone."""

    slope: float
    intercept: float
    name: str = "platt"
    converged: bool = True

    def column(self, probability: Column) -> Column:
        return sigmoid(logit(probability) * self.slope + self.intercept)

    def apply(self, rows: DataFrame, source: str, target: str) -> DataFrame:
        return rows.withColumn(target, self.column(F.col(source)))


@dataclass(frozen=True)
class Isotonic:
    """A monotone map with linear interpolation, flat outside the fitted range.

    ``ceiling`` caps the output at the last fitted value that enough rows support.
    """

    model: IsotonicRegressionModel
    ceiling: float | None
    uncapped: float
    name: str = "isotonic"

    def column(self, probability: Column) -> Column:
        """The map as an expression: a binary search of the fitted boundaries, then interpolation between two of them."""
        knots, values = self.model.boundaries.toArray().tolist(), self.model.predictions.toArray().tolist()
        at, out = F.lit(knots), F.lit(values)
        # Invariant: boundary[low] <= p < boundary[high], where p lies inside the boundaries.
        steps = F.sequence(F.lit(1), F.lit(max(1, len(knots).bit_length())))
        ends = F.struct(F.lit(0).alias("low"), F.lit(len(knots) - 1).alias("high"))

        def narrower(range_: Column, _: Column) -> Column:
            middle = F.floor((range_["low"] + range_["high"]) / 2).cast("int")
            above = F.get(at, middle) <= probability
            return F.struct(
                F.when(above, middle).otherwise(range_["low"]).alias("low"),
                F.when(above, range_["high"]).otherwise(middle).alias("high"),
            )

        def between(range_: Column) -> Column:
            low, high = range_["low"], F.least(range_["low"] + 1, F.lit(len(knots) - 1))
            width = F.get(at, high) - F.get(at, low)
            share = F.try_divide(probability - F.get(at, low), width)
            return F.get(out, low) + F.coalesce(share, F.lit(0.0)) * (F.get(out, high) - F.get(out, low))

        found = F.get(F.transform(F.array(F.aggregate(steps, ends, narrower)), between), F.lit(0))
        free = F.when(probability <= knots[0], values[0]).when(probability >= knots[-1], values[-1]).otherwise(found)
        inside = F.least(F.greatest(free, F.lit(0.0)), F.lit(1.0))
        return inside if self.ceiling is None else F.least(inside, F.lit(self.ceiling))

    def apply(self, rows: DataFrame, source: str, target: str) -> DataFrame:
        return rows.withColumn(target, self.column(F.col(source)))

    def clamped_share(self, rows: DataFrame, source: str) -> DataFrame:
        """Share of rows whose fitted value exceeds the cap."""
        free = Isotonic(self.model, None, self.uncapped).apply(rows, source, "_free")
        over = F.lit(False) if self.ceiling is None else F.col("_free") > self.ceiling
        return free.agg(F.avg(over.cast("double")).alias("clamped_share"))


def _tallied(rows: DataFrame) -> DataFrame:
    """Equal predictions carry no order, so a weight per distinct pair is enough."""
    return rows.groupBy("predicted", F.col("observed").cast("double").alias("observed")).agg(
        F.count(F.lit(1)).cast("double").alias("weight")
    )


def fit_platt(rows: DataFrame, settings: Settings) -> Platt:
    """Unpenalised logistic fit of the outcome on the log-odds of ``predicted``."""
    found = require_probabilities(rows, need_events=True)
    points = _tallied(rows).select(
        logit(F.col("predicted")).alias("log_odds"), "observed", "weight"
    ).persist()
    encode = lambda batch: batch.column("log_odds").to_numpy(zero_copy_only=False)[:, None]
    rate = (found["events"] + 0.5) / (found["rows"] + 1.0)
    try:
        fit, = fit_logistic(points, encode, ["observed"], [rate], settings, 1, weight="weight")
    finally:
        points.unpersist()
    converged = reached(fit.iterations, settings, "the Platt map")
    return Platt(fit.coefficients[0], fit.intercept, converged=converged)


def tail_value(rows: DataFrame, support: int) -> float | None:
    """The largest prediction with at least ``support`` rows at or above it.

    A top-k of a fixed small size, merged from per-task top-k lists.
    """
    top = rows.orderBy(F.col("predicted").desc()).limit(support)
    found = top.agg(F.count(F.lit(1)).alias("n"), F.min("predicted").alias("p")).first()
    return found["p"] if found["n"] >= support else None


def fit_isotonic(rows: DataFrame, settings: Settings) -> Isotonic:
    require_probabilities(rows, need_events=True)
    points = _tallied(rows).withColumnRenamed("predicted", "feature")
    model = IsotonicRegression(
        featuresCol="feature", labelCol="observed", weightCol="weight", isotonic=True
    ).fit(points)
    knots, values = model.boundaries.toArray(), model.predictions.toArray()
    ceiling = None
    if settings.isotonic_tail_rows > 0:
        reach = tail_value(rows, settings.isotonic_tail_rows)
        supported = values[knots <= reach] if reach is not None else values[:0]
        ceiling = float(supported[-1]) if len(supported) else float(values.min())
    return Isotonic(model, ceiling, float(values.max()))


def fit_calibrators(rows: DataFrame, settings: Settings) -> dict[str, Calibrator]:
    fits = {"platt": fit_platt, "isotonic": fit_isotonic}
    fitted = together(*[lambda m=m: fits[m](rows, settings) for m in settings.methods])
    return dict(zip(settings.methods, fitted))
