"""The model design: learned once on training rows, reused verbatim elsewhere.

Statistics are taken over months at risk, but every covariate is fixed at
origination, so they are computed from one row per loan weighted by its months.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintara.functions.splines import Spline, number
from vintara.operators.quantiles import even_steps, exact_quantiles
from vintara.settings import Settings
from vintara.together import together

AGE = "loan_age"
LOG_UPB = "log_original_upb"
MISSING, OTHER = "MISSING", "OTHER"


@dataclass(frozen=True)
class DesignSpec:
    age: Spline | None
    splines: dict[str, Spline]
    linear: dict[str, tuple[float, float]]
    medians: dict[str, float]
    levels: dict[str, list[str]]
    dropped: dict[str, str] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self._features()]

    @property
    def age_width(self) -> int:
        return self.age.size if self.age else 0

    def compact(self) -> list[Column]:
        """What the design is made of in a few narrow columns, which ``encoder`` reads by position."""
        numbers = [_AGE_TEXT] if self.age else []
        numbers += [value_text(c) for c in (*self.splines, *self.linear)]
        out = [F.expr(text) for text in numbers]
        for name, levels in self.levels.items():
            known = ", ".join(quoted(v) for v in levels)
            out.append(F.expr(f"CAST(array_position(array({known}), {level_text(name)}) AS INT)"))
        return [c.alias(f"_d{i}") for i, c in enumerate(out)]

    def encoder(self, kept: Sequence[int] | None = None) -> Callable:
        """A function from an Arrow batch with the ``compact`` columns to the kept design columns.

        The same values as ``columns``, many rows at a time; it needs nothing but numpy where it runs.
        """
        tables = self.factors(kept)
        kept = len(self.names) if kept is None else len(kept)

        def encode(batch) -> np.ndarray:
            return np.hstack([np.empty((batch.num_rows, 0)), *(table[place] for table, place in tables(batch))])

        if not kept:
            return lambda batch: np.empty((batch.num_rows, 0))
        return encode

    def factors(self, kept: Sequence[int] | None = None) -> Callable:
        """Like ``encoder``, in two factors: an array per distinct age and one per run of equal loans, each with every row's place in it.

        ``kept`` is ascending. A loan's months follow each other in the panel; where they do not, its runs are more and shorter.
        """
        age = self.age.evaluator() if self.age else None
        splines = [(s.evaluator(), self.medians[c]) for c, s in self.splines.items()]
        linear = [(mean, deviation, self.medians[c]) for c, (mean, deviation) in self.linear.items()]
        sizes = [len(levels) for levels in self.levels.values()]
        first, count = int(age is not None), len(splines) + len(linear) + len(sizes)
        kept = list(range(len(self.names)) if kept is None else kept)
        by_age = [i for i in kept if i < self.age_width]
        by_loan = [i - self.age_width for i in kept if i >= self.age_width]

        def loan_table(columns: list[tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
            blocks, read = [], iter(columns)
            for basis, median in splines:
                value, missing = next(read)
                blocks += [basis(np.where(missing, median, value)), missing[:, None]]
            for mean, deviation, median in linear:
                value, missing = next(read)
                blocks += [((np.where(missing, median, value) - mean) / deviation)[:, None], missing[:, None]]
            for size in sizes:
                # Levels are numbered from one; the first is the base, zero stands for all others.
                level = next(read)[0][:, None]
                blocks.append(level == np.array([*range(2, size + 1), 0]))
            return np.hstack([np.empty((rows, 0)), *blocks])[:, by_loan]

        def tables(batch) -> list[tuple[np.ndarray, np.ndarray]]:
            columns, begins = [], np.zeros(batch.num_rows, bool)
            begins[:1] = True
            for position in range(first, first + count):
                column = batch.column(f"_d{position}")
                missing = column.is_null().to_numpy(zero_copy_only=False)
                value = column.fill_null(0).to_numpy(zero_copy_only=False).astype(float)
                begins[1:] |= (value[1:] != value[:-1]) | (missing[1:] != missing[:-1])
                columns.append((value, missing))
            starts = np.flatnonzero(begins)
            out = [(loan_table([(v[starts], m[starts]) for v, m in columns], len(starts)), np.cumsum(begins) - 1)]
            if age:
                ages, place = np.unique(batch.column("_d0").to_numpy(zero_copy_only=False).astype(float), return_inverse=True)
                out.insert(0, (age(ages)[:, by_age], place))
            return out

        return tables

    def columns(self) -> list[Column]:
        """Design columns in the order of ``names``."""
        return [F.expr(text) for _, text in self._features()]

    def _features(self) -> list[tuple[str, str]]:
        """(name, SQL expression) pairs; text keeps wide designs cheap to build."""
        out: list[tuple[str, str]] = []

        def flag(name: str, condition: str) -> None:
            out.append((name, f"CASE WHEN {condition} THEN 1.0D ELSE 0.0D END"))

        if self.age:
            basis = self.age.columns(_AGE_TEXT)
            out += [(f"age_spline_{i}", c) for i, c in enumerate(basis)]
        for name, spline in self.splines.items():
            basis = spline.columns(self._filled(name))
            out += [(f"{name}_spline_{i}", c) for i, c in enumerate(basis)]
            flag(f"{name}_is_missing", f"{value_text(name)} IS NULL")
        for name, (mean, deviation) in self.linear.items():
            scaled = f"({self._filled(name)} - {number(mean)}) / {number(deviation)}"
            out.append((f"lin_{name}", scaled))
            flag(f"{name}_is_missing", f"{value_text(name)} IS NULL")
        for name, levels in self.levels.items():
            value = level_text(name)
            for level in levels[1:]:
                flag(f"cat_{name}={level}", f"{value} = {quoted(level)}")
            known = ", ".join(quoted(v) for v in levels)
            flag(f"cat_{name}={OTHER}", f"{value} NOT IN ({known})")
        return out

    def _filled(self, name: str) -> str:
        return f"coalesce({value_text(name)}, {number(self.medians[name])})"

    def effects(self, coefficients: Sequence[float]) -> tuple[Column, Column]:
        """The linear predictor as (loan part, age part), without the intercept.

        The loan part is constant over a loan's months, so a projection evaluates it
        once per loan; every spline block collapses to one cubic.
        """
        weights = list(coefficients)
        if len(weights) != len(self.names):
            raise ValueError(f"{len(weights)} coefficients for {len(self.names)} features")

        def take(count: int) -> list[float]:
            taken, weights[:] = weights[:count], weights[count:]
            return taken

        age, loan = "0.0D", ["0.0D"]
        if self.age:
            age = self.age.effect(_AGE_TEXT, take(self.age.size))

        def gap(name: str) -> None:
            loan.append(f"CASE WHEN {value_text(name)} IS NULL THEN {number(take(1)[0])} ELSE 0.0D END")

        for name, spline in self.splines.items():
            loan.append(spline.effect(self._filled(name), take(spline.size)))
            gap(name)
        for name, (mean, deviation) in self.linear.items():
            slope = number(take(1)[0])
            loan.append(f"({self._filled(name)} - {number(mean)}) / {number(deviation)} * {slope}")
            gap(name)
        for name, levels in self.levels.items():
            kept, other = take(len(levels) - 1), take(1)[0]
            cases = " ".join(
                f"WHEN {quoted(v)} THEN {number(w)}" for v, w in zip(levels, [0.0, *kept])
            )
            loan.append(f"CASE {level_text(name)} {cases} ELSE {number(other)} END")
        return F.expr(" + ".join(f"({part})" for part in loan)), F.expr(age)

    def age_effect(self, coefficients: Sequence[float], age: str) -> str:
        """The age part of the linear predictor as SQL, at an age given as SQL."""
        return self.age.effect(age, list(coefficients)[: self.age.size]) if self.age else "0.0D"

    def to_json(self) -> str:
        # Insertion order is the order of the coefficients, so keys are not sorted.
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> DesignSpec:
        raw = json.loads(text)
        spline = lambda s: Spline(tuple(s["knots"]), s["degree"])
        return cls(
            age=spline(raw["age"]) if raw["age"] else None,
            splines={n: spline(s) for n, s in raw["splines"].items()},
            linear={n: tuple(v) for n, v in raw["linear"].items()},
            medians=raw["medians"],
            levels=raw["levels"],
            dropped=raw["dropped"],
        )


_AGE_TEXT = f"CAST({AGE} AS DOUBLE)"


def quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def value_text(name: str) -> str:
    """A numeric model column as SQL; the log of the loan size is derived."""
    if name == LOG_UPB:
        return "ln(greatest(original_upb, CASE WHEN original_upb IS NOT NULL THEN 1.0D END))"
    return f"CAST({name} AS DOUBLE)"


def raw_value(name: str) -> Column:
    return F.expr(value_text(name))


def source_of(name: str) -> str:
    return "original_upb" if name == LOG_UPB else name


def level_text(name: str) -> str:
    return f"coalesce(CAST({name} AS STRING), {quoted(MISSING)})"


def level_of(name: str) -> Column:
    return F.expr(level_text(name))


def model_columns(settings: Settings) -> list[str]:
    """Panel columns a fit reads; everything else stays unread."""
    wanted = [
        "loan_identifier", "origination_vintage", AGE, "exit_age", "exit_reason",
        "first_observed_age", "default_event", "prepayment_event", "original_upb",
        *(source_of(c) for c in (*settings.spline_columns, *settings.linear_columns)),
        *settings.categorical_columns,
    ]
    return list(dict.fromkeys(wanted))


def loans_with_months(panel: DataFrame) -> DataFrame:
    """One row per loan, its first at-risk month, weighted by its months at risk."""
    return panel.where(F.col(AGE) == F.col("first_observed_age")).withColumn(
        "months", (F.col("exit_age") - F.col("first_observed_age") + 1).cast("long")
    )


def usability(loans: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: can it inform a fit, and if not why. One pass over the loans."""
    present = [c for c in columns if source_of(c) in loans.columns]
    measures = []
    for name in present:
        value = F.col(source_of(name)).cast("string")
        measures += [F.min(value).alias(f"{name}|lo"), F.max(value).alias(f"{name}|hi")]
    row = loans.agg(F.count(F.lit(1)).alias("|rows"), *measures)
    verdicts = []
    for name in columns:
        if name not in present:
            reason, usable = F.lit("not present"), F.lit(False)
        else:
            low, high = F.col(f"`{name}|lo`"), F.col(f"`{name}|hi`")
            usable = F.coalesce(low != high, F.lit(False))
            reason = F.when(low.isNull(), "entirely missing").when(
                low == high, F.concat(F.lit("single value "), low)
            )
        verdicts.append(F.struct(F.lit(name).alias("column"), usable.alias("usable"), reason.alias("reason")))
    return row.select(F.inline(F.array(*verdicts)))


def _long(loans: DataFrame, columns: dict[str, Column]) -> DataFrame:
    pairs = [F.struct(F.lit(n).alias("column"), c.alias("value")) for n, c in columns.items()]
    return loans.select(F.col("months"), F.inline(F.array(*pairs)))


def numeric_quantiles(
    loans: DataFrame, columns: dict[str, Column], probabilities: Sequence[float]
) -> DataFrame:
    """Month-weighted quantiles of several columns, one row per column."""
    return exact_quantiles(_long(loans, columns), ["column"], "value", probabilities, "months")


def numeric_moments(loans: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Month-weighted mean and population deviation, one row per column.

    Deviations are taken around a first estimate of the mean for stability.
    """
    rows = _long(loans, columns).where(F.col("value").isNotNull())
    weight = F.col("months")
    mean = rows.groupBy("column").agg(
        (F.sum(F.col("value") * weight) / F.sum(weight)).alias("mean")
    )
    # One row per model column.
    around = rows.join(F.broadcast(mean), "column")
    square = F.pow(F.col("value") - F.col("mean"), 2.0)
    return around.groupBy("column").agg(
        F.first("mean").alias("mean"),
        F.sqrt(F.sum(square * weight) / F.sum(weight)).alias("deviation"),
    )


def level_shares(loans: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of loans per categorical level; missing is a level of its own."""
    pairs = [F.struct(F.lit(n).alias("column"), level_of(n).alias("level")) for n in columns]
    counts = (
        loans.select(F.inline(F.array(*pairs))).groupBy("column", "level")
        .agg(F.count(F.lit(1)).alias("loans"))
    )
    totals = counts.groupBy("column").agg(F.sum("loans").alias("_all"))
    return counts.join(F.broadcast(totals), "column").withColumn(
        "share", F.col("loans") / F.col("_all")
    ).drop("_all")


def fit_spec(loans: DataFrame, settings: Settings, include_age: bool = True) -> DesignSpec:
    """Learn knots, medians, scales and levels; only summary rows reach the driver.

    ``loans`` is the result of ``loans_with_months`` on the training panel.
    """
    return fit_specs(loans, settings, [settings.age_knots], include_age)[0]


def fit_specs(loans: DataFrame, settings: Settings, knot_counts: Sequence[int], include_age: bool = True) -> list[DesignSpec]:
    """``fit_spec`` for several knot counts, which differ in nothing but the knots, from the same passes."""
    numeric = [*settings.spline_columns, *settings.linear_columns]
    wanted = [*numeric, *settings.categorical_columns]
    present = [c for c in wanted if source_of(c) in loans.columns]
    raw = {c: raw_value(c) for c in numeric if c in present}
    named = [c for c in settings.categorical_columns if c in present]
    floor = F.col("share") >= settings.min_level_share
    nothing: list = []
    # At most 1 / floor levels per column can pass the floor.
    verdicts, middles, kept = together(
        lambda: usability(loans, wanted).collect(),
        lambda: numeric_quantiles(loans, raw, [0.5]).collect() if raw else nothing,
        lambda: level_shares(loans, named).where(floor).collect() if named else nothing,
    )
    dropped = {r["column"]: r["reason"] for r in verdicts if not r["usable"]}
    splined = [c for c in settings.spline_columns if c not in dropped]
    linear = [c for c in settings.linear_columns if c not in dropped]
    medians = {r["column"]: r["quantiles"][0] for r in middles if r["column"] not in dropped}
    filled = {c: F.coalesce(raw[c], F.lit(medians[c])) for c in (*splined, *linear)}
    steps = [even_steps(count - 1) for count in knot_counts]
    ends = np.cumsum([0, *map(len, steps)]).tolist()
    placed, moments = together(
        lambda: numeric_quantiles(loans, {c: filled[c] for c in splined}, sum(steps, [])).collect()
        if splined else nothing,
        lambda: numeric_moments(loans, {c: filled[c] for c in linear}).collect() if linear else nothing,
    )
    knots = {r["column"]: r["quantiles"] for r in placed}
    scales = {
        r["column"]: (r["mean"], r["deviation"] if r["deviation"] > 0.0 else 1.0) for r in moments
    }
    levels: dict[str, list[str]] = {}
    for c in named:
        found = sorted(r["level"] for r in kept if r["column"] == c)
        if c in dropped:
            continue
        if len(found) < 2:
            dropped[c] = f"fewer than two levels reach the {settings.min_level_share:.1%} floor"
        else:
            levels[c] = found
    return [
        DesignSpec(
            age=Spline.uniform(0.0, float(settings.horizon), count) if include_age else None,
            splines={c: Spline.at(knots[c][start:end]) for c in splined},
            linear={c: scales[c] for c in linear},
            medians=medians,
            levels=levels,
            dropped=dropped,
        )
        for count, start, end in zip(knot_counts, ends[:-1], ends[1:])
    ]
