"""Logistic regression by Newton's method on rows of any number.

Every step is one pass: tasks sum the log-likelihood, its slope and its curvature over their
rows, and the driver adds one array per task and outcome, of a size that the features alone
fix. Outcomes, and designs over the same rows, are fitted in the same passes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vintara.settings import Settings


@dataclass(frozen=True)
class Solution:
    intercept: float
    coefficients: tuple[float, ...]
    predicted_events: float
    #: Passes over the rows.
    iterations: int


@dataclass
class _Search:
    """One outcome's coefficients: the best point so far and the point to try next."""

    best: np.ndarray
    trial: np.ndarray
    value: float = -np.inf
    total: float = 0.0
    passes: int = 0
    done: bool = False


@dataclass(frozen=True)
class Problem:
    """One fit: ``encode`` turns an Arrow batch into ``width`` features, as an array or in factors.

    Factors are pairs of an array and each row's place in it, side by side a row's features. Rows that share a place, as the months
    of a loan and the loans of an age do, cost their features once.
    """

    encode: Callable
    outcome: str
    #: The share of events, strictly between 0 and 1, where the search starts.
    rate: float
    width: int
    ridge: float = 0.0


def _sums(
    rows: DataFrame, problems: list[Problem], points: list[np.ndarray], weight: str | None = None, curved: bool = True
) -> list[np.ndarray]:
    """Per problem: (log-likelihood, predicted events), slope and curvature, flattened, from one pass; ``curved`` false leaves the last two at zero."""
    encoders = list(dict.fromkeys(p.encode for p in problems))
    asked = [(encoders.index(p.encode), p.outcome, point) for p, point in zip(problems, points)]
    sizes = [2 + len(point) * (1 + len(point)) for point in points]

    # Nested, so that tasks need nothing but numpy.
    def factors(encoded, count: int) -> list[tuple[np.ndarray, np.ndarray]]:
        parts = [(encoded, np.arange(count))] if isinstance(encoded, np.ndarray) else encoded
        if not all(np.isfinite(table).all() for table, _ in parts):
            raise ValueError("a feature is null or not finite")
        return [(np.ones((1, 1)), np.zeros(count, int)), *parts]

    def product(left, right, times: np.ndarray) -> np.ndarray:
        (a, i), (b, j) = left, right
        if a is b:
            return a.T @ (a * np.bincount(i, times, len(a))[:, None])
        return a.T @ (np.bincount(i * len(b) + j, times, len(a) * len(b)).reshape(len(a), len(b)) @ b)

    def add_up(batches):
        found = [np.zeros(size) for size in sizes]
        for batch in batches:
            if not batch.num_rows:
                continue
            read = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(float)
            times = read(weight) if weight else np.ones(batch.num_rows)
            encoded = [factors(encode(batch), batch.num_rows) for encode in encoders]
            for into, (which, outcome, point) in zip(found, asked):
                parts, y, wide = encoded[which], read(outcome), len(point)
                if np.isnan(y).any():
                    raise ValueError(f"{outcome} is null in some rows")
                ends = np.cumsum([0, *(table.shape[1] for table, _ in parts)])
                spans = [slice(x, z) for x, z in zip(ends[:-1], ends[1:])]
                score = sum((table @ point[span])[place] for (table, place), span in zip(parts, spans))
                p = 0.5 * (1.0 + np.tanh(0.5 * score))
                into[0] += times @ (y * score - np.logaddexp(0.0, score))
                into[1] += times @ p
                if not curved:
                    continue
                slope, curvature = into[2 : 2 + wide], into[2 + wide :].reshape(wide, wide)
                left, bend = times * (y - p), times * p * (1.0 - p)
                for k, (part, span) in enumerate(zip(parts, spans)):
                    table, place = part
                    slope[span] += np.bincount(place, left, len(table)) @ table
                    curvature[span, span] += product(part, part, bend)
                    for other, across in zip(parts[:k], spans[:k]):
                        block = product(other, part, bend)
                        curvature[across, span] += block
                        curvature[span, across] += block.T
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(found).tobytes()], pa.binary())], ["sums"])

    parts = rows.mapInArrow(add_up, "sums binary").collect()
    total = np.sum([np.frombuffer(r["sums"]) for r in parts], axis=0) if parts else np.zeros(sum(sizes))
    return np.split(total, np.cumsum(sizes)[:-1])


def _step(slope: np.ndarray, curvature: np.ndarray, ridge: float) -> np.ndarray:
    """The Newton step. The intercept is eliminated first; directions without curvature stay."""
    weight = max(curvature[0, 0], np.finfo(float).tiny)
    middle = curvature[0, 1:] / weight
    inner = curvature[1:, 1:] - np.outer(middle, curvature[0, 1:]) + ridge * np.eye(len(middle))
    scale = np.sqrt(np.maximum(np.diag(inner), 0.0))
    flat = scale <= 1e-9 * np.sqrt(np.diag(curvature)[1:] + ridge)
    scale[flat] = 1.0
    inner[flat, :] = inner[:, flat] = 0.0
    rest = np.where(flat, 0.0, slope[1:] - middle * slope[0])
    inner_step = np.linalg.lstsq(inner / np.outer(scale, scale), rest / scale, rcond=1e-13)[0] / scale
    return np.concatenate([[slope[0] / weight - middle @ inner_step], inner_step])


def _advance(search: _Search, sums: np.ndarray, ridge: float, settings: Settings) -> None:
    wide = len(search.trial)
    free = np.concatenate([[0.0], search.trial[1:]])
    value = sums[0] - 0.5 * ridge * free @ free
    search.passes += 1
    # A likelihood that fell by more than its own rounding: go half the way back.
    if value < search.value - 1e-12 * abs(search.value):
        search.trial = 0.5 * (search.best + search.trial)
    else:
        search.best, search.value, search.total = search.trial, value, sums[1]
        slope, curvature = sums[2 : 2 + wide] - ridge * free, sums[2 + wide :].reshape(wide, wide)
        step = _step(slope, curvature, ridge)
        search.trial = search.best + step
        # What a step can still gain, twice over; free of the scale of the features, unlike the coefficients.
        if slope @ step <= settings.tolerance:
            search.best, search.done = search.trial, True
            search.total += curvature[0] @ step
    search.done = search.done or search.passes >= settings.max_iterations


def fit_all(rows: DataFrame, problems: list[Problem], settings: Settings, weight: str | None = None) -> list[Solution]:
    """Maximise each problem's log-likelihood less ``ridge / 2`` times the squared slopes, all in the same passes.

    ``rows`` has 0/1 outcomes and, if named, a weight; it is read once per step. Encoders run in tasks, so they should need nothing but numpy there.
    """
    starts = [np.concatenate([[np.log(p.rate / (1.0 - p.rate))], np.zeros(p.width)]) for p in problems]
    searches = [_Search(best=s, trial=s) for s in starts]
    while open_ := [i for i, s in enumerate(searches) if not s.done]:
        found = _sums(rows, [problems[i] for i in open_], [searches[i].trial for i in open_], weight)
        for i, sums in zip(open_, found):
            _advance(searches[i], sums, problems[i].ridge, settings)
    return [Solution(float(s.best[0]), tuple(map(float, s.best[1:])), float(s.total), s.passes) for s in searches]


def fit_logistic(
    rows: DataFrame, encode: Callable, outcomes: list[str], rates: list[float], settings: Settings,
    width: int, ridge: float = 0.0, weight: str | None = None,
) -> list[Solution]:
    """``fit_all`` for outcomes that share their features."""
    return fit_all(rows, [Problem(encode, outcome, rate, width, ridge) for outcome, rate in zip(outcomes, rates)], settings, weight)


def log_likelihoods(rows: DataFrame, problems: list[Problem], fits: list[Solution]) -> list[float]:
    """Each problem's log-likelihood at its solution, without the penalty, from one pass."""
    points = [np.array([fit.intercept, *fit.coefficients]) for fit in fits]
    return [float(sums[0]) for sums in _sums(rows, problems, points, curved=False)]


def varying(rows: DataFrame, encoders: list[Callable], widths: list[int]) -> list[list[int]]:
    """Per encoder into factors the positions of the features that take more than one value, from one pass."""
    ends = np.cumsum([0, *widths])

    def reach(batches):
        low, high = np.full(ends[-1], np.inf), np.full(ends[-1], -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            for encode, start, end in zip(encoders, ends[:-1], ends[1:]):
                tables = [table for table, _ in encode(batch)]
                low[start:end] = np.fmin(low[start:end], np.concatenate([np.fmin.reduce(t, axis=0) for t in tables]))
                high[start:end] = np.fmax(high[start:end], np.concatenate([np.fmax.reduce(t, axis=0) for t in tables]))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (low, high)], ["low", "high"])

    parts = rows.mapInArrow(reach, "low binary, high binary").collect()
    if not parts:
        return [[] for _ in encoders]
    low = np.min([np.frombuffer(r["low"]) for r in parts], axis=0)
    high = np.max([np.frombuffer(r["high"]) for r in parts], axis=0)
    return [np.flatnonzero(low[start:end] < high[start:end]).tolist() for start, end in zip(ends[:-1], ends[1:])]


def weighted_sums(rows: DataFrame, encode: Callable, weights: list[str], width: int) -> dict[str, np.ndarray]:
    """Per weight column its sum, followed by the sums of the features under that weight, from one pass."""

    def add_up(batches):
        found = np.zeros((len(weights), 1 + width))
        for batch in batches:
            if batch.num_rows:
                times = np.stack([batch.column(w).to_numpy(zero_copy_only=False).astype(float) for w in weights])
                found += times @ np.column_stack([np.ones(batch.num_rows), encode(batch)])
        yield pa.RecordBatch.from_arrays([pa.array([found.ravel()], pa.list_(pa.float64()))], ["sums"])

    parts = rows.mapInArrow(add_up, "sums array<double>").collect()
    return dict(zip(weights, np.sum([r["sums"] for r in parts], axis=0).reshape(len(weights), -1)))
