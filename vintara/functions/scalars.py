"""Small column expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Probabilities are kept inside this range before a logit.
LOWEST, HIGHEST = 1e-12, 1.0 - 1e-12


def truth(condition: Column) -> Column:
    """A two-valued flag: unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def month_boundaries(start: Column, end: Column) -> Column:
    """Calendar month boundaries crossed between two dates."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def logit(probability: Column) -> Column:
    inside = F.least(F.greatest(probability, F.lit(LOWEST)), F.lit(HIGHEST))
    return F.ln(inside / (1.0 - inside))


def sigmoid(score: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-score))


def flat_monthly_hazard(probability: Column, window: int) -> Column:
    """The constant hazard that reaches ``probability`` after ``window`` months."""
    inside = F.least(F.greatest(probability, F.lit(0.0)), F.lit(HIGHEST))
    return 1.0 - F.pow(1.0 - inside, F.lit(1.0 / window))


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def in_share(identifier: Column, share: float, seed: int) -> Column:
    """Keyed hash split: membership depends on the identifier alone."""
    if not 0.0 < share < 1.0:
        raise ValueError(f"share must lie in (0, 1), got {share}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), identifier.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") < int(share * 2**32)


def resolved_by(months: Column | int) -> Column:
    """Whether a loan's outcome at ``months`` can be read from its exit."""
    seen_through = F.col("exit_age") >= months - 1
    return seen_through | F.col("exit_reason").isin("default", "prepaid")


def defaulted_by(months: Column | int) -> Column:
    return (F.col("exit_reason") == "default") & (F.col("exit_age") < months)
