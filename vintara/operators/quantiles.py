"""Exact quantiles of groups of any size, and the two ways of cutting at them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintara.operators.ordering import prefix_sums
from vintara.storage import durable

def exact_quantiles(
    values: DataFrame,
    groups: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    weight: str | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group, as an array column ``quantiles``.

    Values are counted first (partial aggregation), and ``weight`` repeats a value
    without expanding rows. The running counts come from range-partitioned prefix sums,
    so a group never has to fit one task.
    """
    groups = list(groups)
    times = F.col(weight) if weight else F.lit(1).cast("long")
    counts = durable(
        values.where(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).cast("double").alias("_v"))
        .agg(F.sum(times).alias("_n"))
    )
    return counted_quantiles(counts, groups, probabilities)


def counted_quantiles(
    counts: DataFrame, groups: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """``exact_quantiles`` of materialised counts ``_n`` per group and distinct value ``_v``."""
    groups = list(groups)
    running = prefix_sums(counts, groups, ["_v"], _c=F.col("_n"))
    if groups:
        # One row per group; joined by a null-safe key, so that a group without a name keeps its quantiles.
        totals = counts.groupBy(*[F.col(g).alias(f"_of_{g}") for g in groups]).agg(F.sum("_n").alias("_total"))
        same = F.lit(True)
        for g in groups:
            same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
        placed = running.join(totals, same).drop(*[f"_of_{g}" for g in groups])
    else:
        placed = running.withColumn("_total", F.lit(counts.agg(F.sum("_n")).first()[0]))
    start = F.col("_c") - F.col("_n")

    def value_at(index: Column) -> Column:
        return F.max(F.when(start <= index, F.col("_v")))

    ends = []
    for i, p in enumerate(probabilities):
        position = F.lit(float(p)) * (F.col("_total") - 1)
        ends += [
            value_at(F.floor(position)).alias(f"_low{i}"),
            value_at(F.ceil(position)).alias(f"_high{i}"),
            F.max(position - F.floor(position)).alias(f"_part{i}"),
        ]
    found = placed.groupBy(*groups).agg(*ends)

    def blend(i: int) -> Column:
        low, high, part = F.col(f"_low{i}"), F.col(f"_high{i}"), F.col(f"_part{i}")
        return F.when(low == high, low).otherwise(low + (high - low) * part)

    return found.select(*groups, F.array(*[blend(i) for i in range(len(probabilities))]).alias("quantiles"))


def even_steps(parts: int) -> list[float]:
    return [i / parts for i in range(parts + 1)]


def distinct_edges(quantiles: Column) -> Column:
    """Ascending edges; tied quantiles merge, so fewer bins may remain."""
    return F.array_sort(F.array_distinct(quantiles))


def _edges_passed(value: Column, edges: Column, limit: int, strict: bool) -> Column:
    """How many edges lie at or below (``strict``: below) the value."""
    passed = F.lit(0)
    for i in range(limit):
        edge = F.get(edges, F.lit(i))
        beyond = value > edge if strict else value >= edge
        passed = passed + F.coalesce(beyond.cast("int"), F.lit(0))
    return passed


def left_closed_bin(value: Column, edges: Column, limit: int) -> Column:
    """Bins ``[a, b)``, the last one closed."""
    last = F.greatest(F.size(edges) - 2, F.lit(0))
    return F.least(F.greatest(_edges_passed(value, edges, limit, False) - 1, F.lit(0)), last)


def right_closed_bin(value: Column, edges: Column, limit: int) -> Column:
    """Bins ``(a, b]``, the first one closed."""
    return F.greatest(_edges_passed(value, edges, limit, True) - 1, F.lit(0))
