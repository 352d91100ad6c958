"""Oracle statements for features and the checkable side of the model fits."""

from __future__ import annotations

from vintara.plans.oracle.base import H, S, TEST, TRAIN, cte, in_list, with_sql
from vintara.plans.oracle.calibration import HOLDOUT_HELD

KNOTS = S.age_knots

cte("t_train", f"SELECT *, ln(greatest(upb, 1e0)) AS log_upb FROM t_panel WHERE yr IN {TRAIN}")
cte("t_train_loans", "SELECT * FROM t_train WHERE age = first_age")

NUMERIC = {
    "classic_fico": "fico", "original_combined_loan_to_value": "cltv",
    "original_debt_to_income_ratio": "dti", "original_interest_rate": "rate",
    "log_original_upb": "log_upb", "original_loan_term": "term",
}
LEVELS = {
    "first_time_homebuyer_indicator": "first_home", "occupancy_status": "occupancy",
    "channel": "channel", "property_type": "'SF'", "loan_purpose": "purpose",
    "number_of_borrowers": "borrowers", "number_of_units": "units", "property_state": "state",
}
cte("t_numbers", " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", {c}::DOUBLE AS v FROM t_train" for n, c in NUMERIC.items()
))
cte("t_number_lists", """
SELECT "column", list_sort(list(v)) AS l, avg(v) AS mean, stddev_pop(v) AS deviation FROM t_numbers WHERE v IS NOT NULL GROUP BY 1
""")
cte("t_number_cuts", f"""
SELECT "column", i, CASE WHEN lo = hi THEN lo ELSE lo + (hi - lo) * (pos - floor(pos)) END AS q
FROM (SELECT "column", i, pos, l[floor(pos)::INTEGER + 1] AS lo, l[ceil(pos)::INTEGER + 1] AS hi
      FROM (SELECT *, (CASE WHEN i = -1 THEN 0.5e0 ELSE i / {KNOTS - 1}e0 END) * (len(l) - 1) AS pos
            FROM t_number_lists, range(-1, {KNOTS}) AS g(i)))
""")
cte("t_levels", " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", coalesce({c}, 'MISSING') AS level FROM t_train_loans" for n, c in LEVELS.items()
))


def spline_basis(x: str, knots: tuple[float, ...], degree: int = 3) -> list[str]:
    """Textbook recursion over the padded knots, valid between the outer knots."""
    low, high = knots[1] - knots[0], knots[-1] - knots[-2]
    t = [knots[0] - (degree - i) * low for i in range(degree)]
    t += list(knots) + [knots[-1] + (i + 1) * high for i in range(degree)]

    def b(j: int, d: int) -> str:
        if d == 0:
            start = ">" if t[j] == knots[-1] else ">="
            end = "<=" if t[j + 1] == knots[-1] else "<"
            return f"(CASE WHEN {x} {start} {t[j]}::DOUBLE AND {x} {end} {t[j + 1]}::DOUBLE THEN 1e0 ELSE 0e0 END)"
        return (
            f"(({x} - {t[j]}::DOUBLE) / {t[j + d] - t[j]}::DOUBLE * {b(j, d - 1)} + "
            f"({t[j + d + 1]}::DOUBLE - {x}) / {t[j + d + 1] - t[j + 1]}::DOUBLE * {b(j + 1, d - 1)})"
        )

    return [b(j, degree) for j in range(len(knots) + degree - 2)]


def _basis_columns(x: str, knots: tuple[float, ...]) -> str:
    return ", ".join(f"round({c}, 9) AS b{i}" for i, c in enumerate(spline_basis(x, knots)))


AGE_KNOTS = tuple(H * i / (KNOTS - 1) for i in range(KNOTS))
_USABLE = " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", min({c}::VARCHAR) AS lo, max({c}::VARCHAR) AS hi FROM t_train_loans"
    for n, c in (NUMERIC | LEVELS).items()
)

SPLINES, LINEAR = in_list(S.spline_columns), in_list(S.linear_columns)
STUDY = (6, 9, 12, 16)


def _recursion(d: int) -> str:
    """One degree of the recursion over lists: function j from functions j and j + 1 of the degree below."""
    return f"""list_transform(range(1, len(t) - {d}), lambda j: (x - t[j]) / (t[j + {d}] - t[j]) * b{d - 1}[j]
        + (t[j + {d + 1}] - x) / (t[j + {d + 1}] - t[j + 1]) * b{d - 1}[j + 1]) AS b{d}"""


def design_ctes(p: str, months: str, loans: str, age: bool) -> None:
    """The whole design of one sample: statistics over its months, entries (id, feature, value) over its loans."""
    def numbers(rows: str) -> str:
        return " UNION ALL ".join(f"SELECT '{n}' AS \"column\", id, {c}::DOUBLE AS v FROM {rows}" for n, c in NUMERIC.items())

    cte(f"{p}_stats", f"""
SELECT "column", quantile_cont(v, 0.5e0) AS median, min(v) AS lo, max(v) AS hi FROM ({numbers(months)}) GROUP BY "column" HAVING min(v) < max(v)
""")
    cte(f"{p}_filled", f"""
SELECT "column", coalesce(v, median) AS v FROM ({numbers(months)}) JOIN {p}_stats USING ("column")
""")
    cte(f"{p}_scales", f"""
SELECT "column", avg(v) AS mean, stddev_pop(v) AS deviation FROM {p}_filled WHERE "column" IN {LINEAR} GROUP BY "column"
""")
    cte(f"{p}_knots", " UNION ALL ".join(
        f"""SELECT {k} AS size, "column", list_sort(list_distinct(quantile_cont(v, {[i / (k - 1) for i in range(k)]}))) AS knots
FROM {p}_filled WHERE "column" IN {SPLINES} GROUP BY "column\"""" for k in dict.fromkeys((KNOTS, *STUDY))
    ))
    cte(f"{p}_pad", f"""
SELECT "column", knots, deg, list_concat(list_concat(
           list_transform(range(1, deg + 1), lambda i: knots[1] - (deg + 1 - i) * (knots[2] - knots[1])), knots),
           list_transform(range(1, deg + 1), lambda i: knots[-1] + i * (knots[-1] - knots[-2]))) AS t
FROM (SELECT *, CASE WHEN len(knots) > 3 THEN 3 ELSE 1 END AS deg FROM {p}_knots WHERE size = {KNOTS})
""")
    cte(f"{p}_values", f"""
SELECT "column", id, v IS NULL AS missing, coalesce(v, median) AS x FROM ({numbers(loans)}) JOIN {p}_stats USING ("column")
""")
    cte(f"{p}_steps", f"""
SELECT *, {_recursion(3)} FROM (SELECT *, {_recursion(2)} FROM (SELECT *, {_recursion(1)} FROM (
SELECT *, list_transform(range(1, len(t)), lambda j: CASE WHEN j = deg + least(len(list_filter(knots, lambda q: q <= x)), len(knots) - 1) THEN 1e0 ELSE 0e0 END) AS b0
FROM (SELECT DISTINCT "column", x FROM {p}_values) JOIN {p}_pad USING ("column"))))
""")
    cte(f"{p}_basis", f"""
SELECT "column", x, i::INTEGER AS i, (CASE WHEN deg = 3 THEN b3 ELSE b1 END)[i + 1] AS b
FROM (SELECT *, unnest(range(0, len(knots) + deg - 2)) AS i FROM {p}_steps)
""")
    cte(f"{p}_levels", " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", id, coalesce({c}, 'MISSING') AS level, {c} AS raw FROM {loans}" for n, c in LEVELS.items()
    ))
    cte(f"{p}_kept", f"""
SELECT "column", level, row_number() OVER (PARTITION BY "column" ORDER BY level) AS rank, count(*) OVER (PARTITION BY "column") AS n_levels
FROM {p}_levels JOIN (SELECT "column" FROM {p}_levels GROUP BY "column" HAVING min(raw) < max(raw)) USING ("column")
GROUP BY "column", level HAVING count(*)::DOUBLE / (SELECT count(*) FROM {loans}) >= {S.min_level_share}
""")
    cte(f"{p}_entries", f"""
SELECT id, "column" || '_spline_' || i AS feature, b AS value FROM {p}_values JOIN {p}_basis USING ("column", x)
UNION ALL SELECT id, "column" || '_is_missing', missing::INTEGER::DOUBLE FROM {p}_values
UNION ALL SELECT id, 'lin_' || "column", (x - mean) / deviation FROM {p}_values JOIN {p}_scales USING ("column")
UNION ALL SELECT id, 'cat_' || k."column" || '=' || k.level, (l.level = k.level)::INTEGER::DOUBLE
    FROM {p}_levels l JOIN {p}_kept k ON l."column" = k."column" WHERE rank > 1
UNION ALL SELECT id, 'cat_' || "column" || '=OTHER', (NOT list_contains(known, level))::INTEGER::DOUBLE
    FROM {p}_levels JOIN (SELECT "column", list(level) AS known FROM {p}_kept WHERE n_levels > 1 GROUP BY "column") USING ("column")
""")
    cte(f"{p}_size", f"""
SELECT size, sum(parameters)::INTEGER AS parameters FROM (
    SELECT size, len(knots) + CASE WHEN len(knots) > 3 THEN 3 ELSE 1 END - 1 AS parameters FROM {p}_knots
    UNION ALL SELECT size, size + {2 if age else 1} FROM (SELECT DISTINCT size FROM {p}_knots)
    UNION ALL SELECT size, n FROM (SELECT DISTINCT size FROM {p}_knots), (SELECT 2 * count(*) AS n FROM {p}_scales)
    UNION ALL SELECT size, n FROM (SELECT DISTINCT size FROM {p}_knots), (SELECT count(*) AS n FROM {p}_kept WHERE n_levels > 1)) GROUP BY size
""")


cte("t_fit", f"SELECT * FROM t_train WHERE NOT {HOLDOUT_HELD}")
cte("t_fit_loans", "SELECT * FROM t_fit WHERE age = first_age")
cte("t_window", "SELECT l.*, b.bad FROM t_fit_loans l JOIN t_binary b ON b.id = l.id AND b.ok")
design_ctes("t_all", "t_train", "t_train_loans", True)
design_ctes("t_held_out", "t_fit", "t_fit_loans", True)
design_ctes("t_window_fit", "t_window", "t_window", False)
_AGE_BASIS = [(f"age_spline_{i}", c) for i, c in enumerate(spline_basis("age::DOUBLE", AGE_KNOTS))]


def _weighted(features: str) -> str:
    return f"SELECT cause, feature, round(sum(value * y) + 0e0, 1) + 0e0 AS weighted_events FROM ({features}) GROUP BY ALL"


_CAUSES = "(SELECT 'default' AS cause, id, age, y_def::INTEGER AS y FROM t_fit UNION ALL SELECT 'prepayment', id, age, y_pre::INTEGER FROM t_fit)"
_FEATURES = f"""
SELECT cause, 'intercept' AS feature, 1e0 AS value, y FROM {_CAUSES}
UNION ALL SELECT cause, feature, value, y FROM {_CAUSES} JOIN t_held_out_entries USING (id) WHERE y = 1
UNION ALL SELECT DISTINCT cause, feature, 0e0, 0 FROM (SELECT DISTINCT feature FROM t_held_out_entries), (SELECT unnest(['default', 'prepayment']) AS cause)
""" + "".join(f" UNION ALL SELECT cause, '{n}', {c}, y FROM {_CAUSES}" for n, c in _AGE_BASIS)
_WINDOW_FEATURES = """
SELECT 'window' AS cause, 'intercept' AS feature, 1e0 AS value, bad::INTEGER AS y FROM t_window
UNION ALL SELECT 'window', feature, value, bad::INTEGER FROM t_window JOIN t_window_fit_entries USING (id)
"""
FIRST, *LATER = S.test_cohorts

STATEMENTS = {
    "f1_usability": with_sql(f"""
        SELECT "column", coalesce(lo <> hi, false) AS usable,
               CASE WHEN lo IS NULL THEN 'entirely missing' WHEN lo = hi THEN 'single value ' || lo END AS reason FROM ({_USABLE})
        UNION ALL SELECT 'vantagescore_4_0', false, 'not present'"""),
    "f2_numeric_statistics": with_sql("""
        SELECT "column", round(max(q) FILTER (WHERE i = -1), 9) AS median,
               array_to_string(list_transform(list_sort(list(DISTINCT q) FILTER (WHERE i >= 0)), lambda k: round(k, 6)::VARCHAR), ' ') AS knots,
               round(any_value(mean), 9) AS mean, round(any_value(deviation), 9) AS deviation
        FROM t_number_cuts JOIN t_number_lists USING ("column") GROUP BY "column\""""),
    "f3_level_shares": with_sql(f"""
        SELECT "column", level, count(*) AS loans, round(count(*)::DOUBLE / n, 9) AS share,
               count(*)::DOUBLE / n >= {S.min_level_share} AS kept
        FROM t_levels, (SELECT count(*) AS n FROM t_train_loans) GROUP BY "column", level, n"""),
    "f4_age_basis": with_sql(f"""
        SELECT loan_age, {_basis_columns('loan_age::DOUBLE', AGE_KNOTS)} FROM (SELECT DISTINCT age AS loan_age FROM t_panel)"""),
    "f4_covariate_basis": with_sql(f"""
        SELECT "column", round(x, 6) AS value, missing, loans, i AS position, round(b, 9) AS basis
        FROM (SELECT "column", x, missing, count(*) AS loans FROM t_all_values WHERE "column" IN {SPLINES} GROUP BY ALL)
        JOIN t_all_basis USING ("column", x)"""),
    "f5_encoded_design": with_sql("SELECT id AS loan_identifier, feature, round(value, 7) AS value FROM t_all_entries" + "".join(
        f" UNION ALL SELECT id, '{n}', round({c}, 7) FROM t_train_loans" for n, c in _AGE_BASIS)),
    "h5_score_equations": with_sql(_weighted(_FEATURES)),
    "b2_score_equations": with_sql(f"SELECT feature, weighted_events FROM ({_weighted(_WINDOW_FEATURES)})"),
    "h1_hazard_fit": with_sql(f"""
        SELECT cause, count(*) AS rows, sum(y)::BIGINT AS events, round(sum(y) / count(*), 9) AS base_rate,
               true AS converged, true AS below_cap
        FROM (SELECT 'default' AS cause, y_def::INTEGER AS y FROM t_train WHERE NOT {HOLDOUT_HELD}
              UNION ALL SELECT 'prepayment', y_pre::INTEGER FROM t_train WHERE NOT {HOLDOUT_HELD}) GROUP BY cause"""),
    "h6_model_card": f"""SELECT 2 AS format_version, {H} AS horizon, {S.holdout_share}::DOUBLE AS holdout_share,
        'default' AS first_cause, 2 AS causes, true AS matches""",
    "b2_binary_fit": with_sql(f"""
        SELECT count(*) FILTER (WHERE ok) AS rows, count(*) FILTER (WHERE ok AND bad) AS events,
               count(*) FILTER (WHERE NOT ok) AS unresolved, true AS converged
        FROM t_binary WHERE yr IN {TRAIN} AND NOT held"""),
    "m1_knot_penalties": with_sql(f"""
        SELECT size AS knots, parameters, round(parameters * ln(n), 5) AS penalty_by_rows,
               round(parameters * ln(events), 5) AS penalty_by_events, true AS converged
        FROM t_all_size, (SELECT count(*) AS n, sum(y_def::INTEGER) AS events FROM t_train) WHERE size IN {STUDY}"""),
    "k6_platt_fit": with_sql(f"""
        SELECT count(*) AS rows, sum(y_def::INTEGER)::BIGINT AS events, round(sum(y_def::INTEGER)::DOUBLE, 3) AS weighted_events,
               round(sum(y_def::INTEGER * ln(hd / (1e0 - hd))), 3) AS weighted_log_odds
        FROM t_scored WHERE yr IN {TRAIN} AND held"""),
    "k7_isotonic_fit": with_sql(f"""
        SELECT count(*) AS rows, sum(y_def::INTEGER)::DOUBLE AS weighted_events, 0::BIGINT AS falls, 0::BIGINT AS outside
        FROM t_scored WHERE yr IN {TRAIN} AND held"""),
    "k9_score_rows": with_sql(f"""
        SELECT CASE WHEN yr IN {TEST} THEN 'test (out-of-time)' WHEN held THEN 'holdout (in-time)' ELSE 'train (in-sample)' END AS population,
               count(*) AS rows, sum(y_def::INTEGER)::BIGINT AS events, true AS probabilities FROM t_scored GROUP BY 1"""),
    "k12_sequential": with_sql(f"""
        SELECT yr AS origination_vintage, count(*) AS rows, sum(y_def::INTEGER)::BIGINT AS events, true AS probabilities
        FROM t_scored WHERE yr IN {in_list(LATER)} GROUP BY yr"""),
}
