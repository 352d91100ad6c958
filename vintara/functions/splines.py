"""B-spline bases as piecewise polynomials in native expressions.

The polynomial pieces of every basis function are worked out once from the knots.
A row then needs one interval test and a cubic, and a whole fitted spline effect
collapses into a single cubic per interval.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from numpy.polynomial import polynomial as P


@dataclass(frozen=True)
class Spline:
    """Knots and degree of a basis; linear beyond the outer knots, last column dropped."""

    knots: tuple[float, ...]
    degree: int = 3

    @classmethod
    def uniform(cls, low: float, high: float, count: int) -> Spline:
        return cls(tuple(float(k) for k in np.linspace(low, high, count)))

    @classmethod
    def at(cls, quantiles: Sequence[float]) -> Spline:
        """Knots at quantiles; merged quantiles can leave too few for a cubic."""
        knots = tuple(sorted(set(float(q) for q in quantiles)))
        return cls(knots, 3 if len(knots) > 3 else 1)

    @property
    def size(self) -> int:
        return len(self.knots) + self.degree - 2

    def _padded(self) -> np.ndarray:
        base, reach = np.asarray(self.knots), np.arange(self.degree, 0, -1)
        left = base[0] - reach * (base[1] - base[0])
        right = base[-1] + reach[::-1] * (base[-1] - base[-2])
        return np.concatenate([left, base, right])

    def pieces(self) -> list[tuple[float, np.ndarray]]:
        """(anchor, coefficients[basis, power]) for left tail, intervals, right tail.

        Coefficients are in powers of ``x - anchor``. All basis functions are kept
        here, including the one dropped from the design.
        """
        t, p, base = self._padded(), self.degree, self.knots
        count = len(base) + p - 1
        inner = []
        for k in range(p, p + len(base) - 1):
            anchor = t[k]
            # Degree by degree, only functions whose support covers interval k.
            current = {k: np.array([1.0])}
            for d in range(1, p + 1):
                grown: dict[int, np.ndarray] = {}
                for j in range(k - d, k + 1):
                    total = np.zeros(1)
                    if j in current:
                        rise = np.array([anchor - t[j], 1.0]) / (t[j + d] - t[j])
                        total = P.polyadd(total, P.polymul(rise, current[j]))
                    if j + 1 in current:
                        fall = np.array([t[j + d + 1] - anchor, -1.0]) / (t[j + d + 1] - t[j + 1])
                        total = P.polyadd(total, P.polymul(fall, current[j + 1]))
                    grown[j] = total
                current = grown
            table = np.zeros((count, p + 1))
            for j, poly in current.items():
                table[j, : len(poly)] = poly
            inner.append((float(anchor), table))
        first = inner[0][1][:, :2].copy()
        width = base[-1] - base[-2]
        last = inner[-1][1]
        value = np.array([P.polyval(width, row) for row in last])
        slope = np.array([P.polyval(width, P.polyder(row)) for row in last])
        tail = (float(base[-1]), np.stack([value, slope], axis=1))
        return [(float(base[0]), first), *inner, tail]

    def _choose(self, x: str, polynomials: list[str]) -> str:
        """Pick the piece holding ``x``: left tail, [k, k+1) ..., last closed, right tail."""
        cases = [f"WHEN {x} < {number(self.knots[0])} THEN {polynomials[0]}"]
        for upper, poly in zip(self.knots[1:-1], polynomials[1:-2]):
            cases.append(f"WHEN {x} < {number(upper)} THEN {poly}")
        cases.append(f"WHEN {x} <= {number(self.knots[-1])} THEN {polynomials[-2]}")
        return f"CASE {' '.join(cases)} ELSE {polynomials[-1]} END"

    def columns(self, x: str) -> list[str]:
        """The design columns of this basis, as SQL expressions of ``x``."""
        pieces = self.pieces()
        return [
            self._choose(x, [_polynomial(x, a, table[j]) for a, table in pieces])
            for j in range(self.size)
        ]

    def evaluator(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function from values to the design columns, one row per value; it needs nothing but numpy where it runs."""
        size, knots, pieces = self.size, np.asarray(self.knots), self.pieces()
        anchors = np.array([anchor for anchor, _ in pieces])
        tables = np.zeros((len(pieces), size, self.degree + 1))
        for into, (_, table) in zip(tables, pieces):
            into[:, : table.shape[1]] = table[:size]

        def columns(x: np.ndarray) -> np.ndarray:
            at = np.searchsorted(knots, x, side="right") - (x == knots[-1])
            away, table = (x - anchors[at])[:, None], tables[at]
            out = table[:, :, -1]
            for power in range(table.shape[2] - 2, -1, -1):
                out = out * away + table[:, :, power]
            return out

        return columns

    def effect(self, x: str, weights: Sequence[float]) -> str:
        """The weighted sum of the design columns as one polynomial per interval."""
        w = np.asarray(weights, dtype=float)
        return self._choose(
            x, [_polynomial(x, a, w @ table[: self.size]) for a, table in self.pieces()]
        )


def number(value: float) -> str:
    """A double literal."""
    return f"({float(value)!r}D)"


def _polynomial(x: str, anchor: float, coefficients: np.ndarray) -> str:
    """Horner form; leading zeros are left out."""
    used = list(coefficients)
    while len(used) > 1 and used[-1] == 0.0:
        used.pop()
    out = number(used[-1])
    for c in reversed(used[:-1]):
        out = f"({out} * ({x} - {number(anchor)}) + {number(c)})"
    return out
