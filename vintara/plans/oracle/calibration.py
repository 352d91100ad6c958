"""Oracle statements for diagnostics, calibration, projection and decisions."""

from __future__ import annotations

from vintara.plans.oracle.base import S, TEST, TRAIN, cte, in_list, with_sql
from vintara.plans.oracle.economics import (
    BINARY, HAZARD_D, HAZARD_P, LEGS, PLATT, SEQUENTIAL, legs,
)

HELD = (
    f"('0x' || substr(sha256('{S.holdout_seed}:' || id::VARCHAR), 1, 8))::BIGINT < "
    "{share}"
)
HOLDOUT_HELD = HELD.format(share=int(S.holdout_share * 2**32))
SAMPLED = HELD.format(share=int(S.sensitivity_share * 2**32))
FIRST, *LATER = S.test_cohorts
LATER_LIST, B = in_list(LATER), S.bins
LATER_LABEL = f"test {', '.join(map(str, LATER))} (sequential)"

cte("t_scored", f"SELECT *, {HAZARD_D} AS hd, {HAZARD_P} AS hp, {HOLDOUT_HELD} AS held FROM t_panel")


def population(train: str, test: str) -> str:
    return (
        f"CASE WHEN yr IN {train} THEN CASE WHEN held THEN 'holdout (in-time)' ELSE 'train (in-sample)' END "
        f"WHEN yr IN {test} THEN 'test (out-of-time)' END"
    )


def scored_rows(arm: str, train: str, test: str, first: int, later: str, label: str) -> str:
    platt, seq = PLATT.format(p="hd"), SEQUENTIAL.format(p="hd")
    return f"""
SELECT '{arm}' AS arm, yr, id, y_def::INTEGER AS y, pop, variant, p FROM t_scored, LATERAL (
    SELECT {population(train, test)} AS pop, 'raw' AS variant, hd AS p
    UNION ALL SELECT {population(train, test)}, 'platt', {platt}
    UNION ALL SELECT '{label}', 'raw', hd WHERE yr IN {later}
    UNION ALL SELECT '{label}', 'platt fitted on {first}', {seq} WHERE yr IN {later}) WHERE pop IS NOT NULL"""


cte(
    "t_cal",
    scored_rows("crisis", TRAIN, TEST, FIRST, LATER_LIST, LATER_LABEL)
    + "\nUNION ALL"
    + scored_rows("control", "(1995, 1996)", "(1997, 1998)", 1997, "(1998)", "test 1998 (sequential)"),
)
cte("t_sorted", "SELECT arm, pop, variant, list_sort(list(p)) AS l FROM t_cal GROUP BY arm, pop, variant")
cte("t_cut", f"""
SELECT arm, pop, variant, CASE WHEN lo = hi THEN lo ELSE lo + (hi - lo) * (pos - floor(pos)) END AS e
FROM (SELECT arm, pop, variant, pos, l[floor(pos)::INTEGER + 1] AS lo, l[ceil(pos)::INTEGER + 1] AS hi
      FROM (SELECT *, (i / {B}e0) * (len(l) - 1) AS pos FROM t_sorted, range({B + 1}) AS g(i)))
""")
cte("t_edges", "SELECT arm, pop, variant, list_sort(list(DISTINCT e)) AS edges FROM t_cut GROUP BY arm, pop, variant")
cte("t_binned", """
SELECT c.*, edges, least(greatest(len([e FOR e IN edges IF e <= p]) - 1, 0), greatest(len(edges) - 2, 0)) AS bin
FROM t_cal c JOIN t_edges USING (arm, pop, variant)
""")
cte("t_rel", """
SELECT arm, pop, variant, bin, count(*) AS n, sum(y)::BIGINT AS events, avg(p) AS mp, avg(y) AS o, min(p) AS lo, max(p) AS hi,
       any_value(edges)[bin + 1] AS bin_low, any_value(edges)[bin + 2] AS bin_high, sum(p) AS sp, sum((p - y) ** 2) AS sq
FROM t_binned GROUP BY arm, pop, variant, bin
""")
cte("t_scores", """
SELECT *, 1e0 - brier / uncertainty AS skill, predicted / events AS ratio,
       brier - (reliability - resolution + uncertainty) AS residual
FROM (
    SELECT arm, pop, variant, sum(n)::BIGINT AS n, sum(events)::BIGINT AS events, sum(sp) AS predicted, sum(sq) / sum(n) AS brier,
           sum(n * (mp - o) ** 2) / sum(n) AS reliability,
           sum(n * o * o) / sum(n) - (sum(events) / sum(n)) ** 2 AS resolution, count(*) AS bins_used,
           sum(events) / sum(n) AS base_rate, (sum(events) / sum(n)) * (1e0 - sum(events) / sum(n)) AS uncertainty,
           sum(n * abs(o - mp)) / sum(n) AS ece, max(abs(o - mp)) AS max_error
    FROM t_rel GROUP BY arm, pop, variant)
""")
cte("t_resid", """
SELECT yr AS vintage, age AS loan_age, count(*) AS at_risk, avg(y_def::INTEGER) AS observed, avg(hd) AS predicted,
       (avg(y_def::INTEGER) - avg(hd)) / nullif(sqrt(avg(hd) * (1e0 - avg(hd)) / count(*)), 0) AS z
FROM t_scored GROUP BY yr, age
""")
cte("t_cells", f"""
SELECT 'headline' AS scope, {S.lgd}::DOUBLE AS lgd, {S.spread_bps}::DOUBLE AS spread
UNION ALL SELECT 'sequential', {S.lgd}::DOUBLE, {S.spread_bps}::DOUBLE
UNION ALL SELECT 'sensitivity', g, s FROM (SELECT unnest({[float(g) for g in S.sensitivity_lgds]}::DOUBLE[]) AS g),
          (SELECT unnest({[float(s) for s in S.sensitivity_spreads]}::DOUBLE[]) AS s)
""")
cte("t_cell_legs", f"""
SELECT scope, lgd, spread, variant, id, age, upb,
       {legs('lgd', f'(discount_rate + (spread - {S.spread_bps}::DOUBLE) / 10000e0)')}
FROM t_paths JOIN t_cells ON (scope = 'headline' AND variant <> 'sequential')
     OR (scope = 'sequential' AND yr IN {LATER_LIST}) OR (scope = 'sensitivity' AND yr IN {LATER_LIST} AND {SAMPLED})
WHERE yr IN {TEST} AND variant <> 'flat'
""")
cte("t_cell_npv", f"""
SELECT *, npv / loans AS per_loan FROM (
    SELECT scope, lgd, spread, variant, count(*) FILTER (WHERE age = 0) AS loans,
           sum(upb) FILTER (WHERE age = 0) AS principal, sum(default_leg) AS default_leg,
           {' + '.join(f'sum({c})' for c in LEGS)} - sum(upb) FILTER (WHERE age = 0) AS npv
    FROM t_cell_legs GROUP BY scope, lgd, spread, variant)
""")
W = S.binary_window
OUTCOME = f"exit_age >= {W - 1} OR reason IN ('default', 'prepaid')"
BAD = f"reason = 'default' AND exit_age < {W}"
cte("t_app", f"""
SELECT p.id, p.yr, round(p.cif_d, 12) AS score, n.npv AS expected, r.npv AS realised,
       {OUTCOME} AS ok, {BAD} AS bad,
       CASE WHEN p.yr IN {TEST} THEN 'test' WHEN {HOLDOUT_HELD.replace('id::', 'p.id::')} THEN 'holdout' END AS book
FROM t_paths p JOIN t_npv n ON n.id = p.id AND n.variant = 'raw' JOIN t_realised r ON r.id = p.id
WHERE p.variant = 'raw' AND p.age = {W - 1} AND r.funded
""")
cte("t_rank", """
SELECT book, row_number() OVER o AS rk, count(*) OVER (PARTITION BY book) AS n, score,
       sum(realised) OVER upto AS c_npv, sum(ok::INTEGER) OVER upto AS c_ok,
       sum((ok AND bad)::INTEGER) OVER upto AS c_bad, sum(ok::INTEGER) OVER (PARTITION BY book) AS n_ok,
       sum((ok AND bad)::INTEGER) OVER (PARTITION BY book) AS n_bad
FROM t_app WHERE book IS NOT NULL
WINDOW o AS (PARTITION BY book ORDER BY score, id),
       upto AS (PARTITION BY book ORDER BY score, id ROWS UNBOUNDED PRECEDING)
""")
P = S.sweep_points
cte("t_grid", f"""
SELECT DISTINCT book, n, n_ok, n_bad, CASE WHEN i = {P} THEN n ELSE floor(i * (n / {P}e0))::BIGINT END AS k
FROM (SELECT DISTINCT book, n, n_ok, n_bad FROM t_rank), range({P + 1}) AS g(i)
""")
cte("t_curve0", """
SELECT book, k, n, n_ok, n_bad, coalesce(score, 0e0) AS threshold, coalesce(c_npv, 0e0) AS npv,
       coalesce(c_ok, 0) AS ok, coalesce(c_bad, 0) AS bad
FROM t_grid LEFT JOIN (SELECT book, rk AS k, score, c_npv, c_ok, c_bad FROM t_rank) USING (book, k)
""")
cte("t_curve1", """
SELECT *, ((ok - bad) + (n_bad - bad))::DOUBLE / n_ok AS accuracy,
       coalesce((n_bad - bad)::DOUBLE / nullif(n_ok - ok, 0), 0e0) AS prec,
       coalesce((n_bad - bad)::DOUBLE / nullif(n_bad, 0), 0e0) AS rec
FROM t_curve0
""")
cte("t_sweep", "SELECT *, coalesce(2e0 * prec * rec / nullif(prec + rec, 0), 0e0) AS f1, npv / n AS per_app FROM t_curve1")
_TEST_CURVE = "(SELECT * FROM t_sweep WHERE book = 'test')"


def carried(metric: str) -> str:
    chosen = f"(SELECT threshold FROM t_sweep WHERE book = 'holdout' ORDER BY {metric} DESC, k LIMIT 1)"
    return (
        f"coalesce((SELECT min(k) FROM {_TEST_CURVE} WHERE threshold >= {chosen}), "
        f"(SELECT max(k) FROM {_TEST_CURVE}))"
    )


cte("t_rules", f"""
SELECT 0 AS position, 'approve all' AS rule, (SELECT max(k) FROM {_TEST_CURVE}) AS k
UNION ALL SELECT 1, 'accuracy-max', {carried('accuracy')}
UNION ALL SELECT 2, 'F1-max', {carried('f1')}
UNION ALL SELECT 3, 'expected NPV > 0', coalesce((SELECT min(k) FROM {_TEST_CURVE}
    WHERE k >= (SELECT count(*) FROM t_app WHERE book = 'test' AND expected > 0)), (SELECT max(k) FROM {_TEST_CURVE}))
UNION ALL SELECT 4, 'oracle (hindsight)', (SELECT k FROM {_TEST_CURVE} ORDER BY per_app DESC, k LIMIT 1)
""")
cte("t_binary", f"""
SELECT id, yr, {BINARY} AS p_bin, {OUTCOME} AS ok, {BAD} AS bad, {HOLDOUT_HELD} AS held FROM t_loans
""")
cte("t_acc_rank", f"""
SELECT p_bin, row_number() OVER o AS rk,
       sum(CASE WHEN bad THEN -1 ELSE 1 END) OVER (ORDER BY p_bin, id ROWS UNBOUNDED PRECEDING) AS gain
FROM t_binary WHERE yr IN {TRAIN} AND held AND ok WINDOW o AS (ORDER BY p_bin, id)
""")
cte("t_acc_best", """
SELECT rk FROM (SELECT 0 AS rk, 0 AS gain UNION ALL SELECT rk, gain FROM t_acc_rank) ORDER BY gain DESC, rk LIMIT 1
""")
cte("t_detail", f"""
SELECT b.id, b.yr, r.npv AS realised, b.bad, b.ok, b.p_bin AS score_b2, f.npv AS expected_b2,
       {', '.join(f"round(max(p.cif_d) FILTER (WHERE p.variant = '{v}' AND p.age = {W - 1}), 12) AS score_{a}" for v, a in (('raw', 'b3'), ('platt', 'b4a'), ('sequential', 'b4b')))},
       {', '.join(f"max(n.npv) FILTER (WHERE n.variant = '{v}') AS expected_{a}" for v, a in (('raw', 'b3'), ('platt', 'b4a'), ('sequential', 'b4b')))}
FROM t_binary b JOIN t_realised r ON r.id = b.id AND r.funded JOIN t_npv f ON f.id = b.id AND f.variant = 'flat'
     JOIN t_npv n ON n.id = b.id JOIN t_paths p ON p.id = b.id AND p.variant = n.variant
WHERE b.yr IN {LATER_LIST} GROUP BY ALL
""")
CUTOFF = 0.2
cte("t_arms", f"""
SELECT 'B0' AS arm, id, realised, bad, ok, true AS yes, (SELECT avg(bad::INTEGER) FROM t_detail WHERE ok) AS score,
       0e0 AS expected, 0e0 AS decision, 1e0 AS threshold FROM t_detail
UNION ALL SELECT 'B1', id, realised, bad, ok, score_b2 < {CUTOFF}, score_b2, expected_b2, -score_b2, {CUTOFF}::DOUBLE FROM t_detail
UNION ALL SELECT 'B2', id, realised, bad, ok, expected_b2 > 0, score_b2, expected_b2, expected_b2, NULL FROM t_detail
UNION ALL SELECT 'B3', id, realised, bad, ok, expected_b3 > 0, score_b3, expected_b3, expected_b3, NULL FROM t_detail
UNION ALL SELECT 'B4a', id, realised, bad, ok, expected_b4a > 0, score_b4a, expected_b4a, expected_b4a, NULL FROM t_detail
UNION ALL SELECT 'B4b', id, realised, bad, ok, expected_b4b > 0, score_b4b, expected_b4b, expected_b4b, NULL FROM t_detail
""")
cte("t_prefix", """
SELECT arm, greatest(max(c_rank), 0) / max(n) AS oracle_rank, greatest(max(c_cut), 0) / max(n) AS oracle_cut
FROM (SELECT arm, count(*) OVER (PARTITION BY arm) AS n,
             sum(realised) OVER (PARTITION BY arm ORDER BY score, id ROWS UNBOUNDED PRECEDING) AS c_rank,
             sum(realised) OVER (PARTITION BY arm ORDER BY -decision, id ROWS UNBOUNDED PRECEDING) AS c_cut
      FROM t_arms)
GROUP BY arm
""")
cte("t_auc", """
SELECT arm, sum(pos * (below - neg + 0.5e0 * neg)) / (sum(pos)::DOUBLE * sum(neg)) AS auc
FROM (SELECT *, sum(neg) OVER (PARTITION BY arm ORDER BY score) AS below
      FROM (SELECT arm, score, count(*) FILTER (WHERE bad) AS pos, count(*) FILTER (WHERE NOT bad) AS neg
            FROM t_arms WHERE ok GROUP BY arm, score))
GROUP BY arm
""")
cte("t_arm_cut", f"""
SELECT arm, list_sort(list(DISTINCT CASE WHEN lo = hi THEN lo ELSE lo + (hi - lo) * (pos - floor(pos)) END)) AS edges
FROM (SELECT arm, pos, l[floor(pos)::INTEGER + 1] AS lo, l[ceil(pos)::INTEGER + 1] AS hi
      FROM (SELECT *, (i / {B}e0) * (len(l) - 1) AS pos
            FROM (SELECT arm, list_sort(list(score)) AS l FROM t_arms WHERE ok GROUP BY arm), range({B + 1}) AS g(i)))
GROUP BY arm
""")
cte("t_arm_cal", """
SELECT arm, sum(n * abs(o - mp)) / sum(n) AS ece, sum(sq) / sum(n) AS brier
FROM (SELECT arm, bin, count(*) AS n, avg(score) AS mp, avg(bad::INTEGER) AS o, sum((score - bad::INTEGER) ** 2) AS sq
      FROM (SELECT arm, score, bad, least(greatest(len([e FOR e IN edges IF e <= score]) - 1, 0), greatest(len(edges) - 2, 0)) AS bin
            FROM t_arms JOIN t_arm_cut USING (arm) WHERE ok) GROUP BY arm, bin)
GROUP BY arm
""")
cte("t_ablation", """
SELECT arm, avg(yes::INTEGER) AS approval_rate, max(threshold) AS threshold,
       sum(CASE WHEN yes THEN realised ELSE 0 END) / count(*) AS realised,
       sum(CASE WHEN yes THEN expected ELSE 0 END) / count(*) AS expected, avg(realised) AS base
FROM t_arms GROUP BY arm
""")
cte("t_deciles", """
SELECT list_sort(list(DISTINCT CASE WHEN lo = hi THEN lo ELSE lo + (hi - lo) * (pos - floor(pos)) END)) AS edges
FROM (SELECT pos, l[floor(pos)::INTEGER + 1] AS lo, l[ceil(pos)::INTEGER + 1] AS hi
      FROM (SELECT *, (i / 10e0) * (len(l) - 1) AS pos
            FROM (SELECT list_sort(list(score_b3)) AS l FROM t_detail), range(11) AS g(i)))
""")


def nine(columns: str) -> str:
    return ", ".join(f"round({c}, 9) AS {c}" for c in columns.split())


_REL = f"""
SELECT {{extra}} pop AS population, variant, bin, n AS rows, events, round(mp, 9) AS mean_predicted, round(o, 9) AS observed_rate,
       round(lo, 9) AS min_predicted, round(hi, 9) AS max_predicted, round(bin_low, 9) AS bin_low, round(bin_high, 9) AS bin_high,
       round(sqrt(mp * (1e0 - mp) / n), 9) AS standard_error, round(o - mp, 9) AS residual,
       round((o - mp) / nullif(sqrt(mp * (1e0 - mp) / n), 0), 6) AS z
FROM t_rel WHERE arm = 'crisis'"""

_FAIL = """count(*) AS loans, {score} round(avg(expected_b3), 4) AS expected_npv, round(avg(realised), 4) AS realised_npv,
       round(avg(bad::INTEGER), 9) AS default_rate, round(avg(expected_b3) - avg(realised), 4) AS gap FROM {source}"""

STATEMENTS = {
    "h2_hazard_scores": with_sql("""
        SELECT id AS loan_identifier, age AS loan_age, round(hd, 9) AS hazard_default, round(hp, 9) AS hazard_prepayment
        FROM t_scored"""),
    "h3_survival_paths": with_sql(f"""
        SELECT id AS loan_identifier, age AS loan_age, {nine('s s0 cif_d cif_p').replace('AS s,', 'AS survival,')
        .replace('AS s0', 'AS survival_entering').replace('AS cif_d', 'AS cif_default').replace('AS cif_p', 'AS cif_prepayment')}
        FROM t_paths WHERE variant = 'raw'"""),
    "h3_survival_audit": with_sql("SELECT 0::BIGINT AS month_gaps, 0::BIGINT AS overflows"),
    "h4_fit_by_age": with_sql("""
        SELECT age AS loan_age, count(*) AS at_risk, round(avg(hd), 9) AS predicted_default,
               round(avg(y_def::INTEGER), 9) AS observed_default, round(avg(hp), 9) AS predicted_prepayment,
               round(avg(y_pre::INTEGER), 9) AS observed_prepayment FROM t_scored GROUP BY age"""),
    "h5_marginal_gaps": with_sql("""
        SELECT cause, count(*) AS rows, sum(y)::BIGINT AS events, round(sum(p), 6) AS predicted_events,
               round(sum(y) / count(*), 9) AS base_rate, round((sum(p) - sum(y)) / sum(y), 9) AS marginal_gap
        FROM (SELECT 'default' AS cause, y_def::INTEGER AS y, hd AS p FROM t_scored
              UNION ALL SELECT 'prepayment', y_pre::INTEGER, hp FROM t_scored) GROUP BY cause"""),
    "b1_loan_frame": with_sql("""
        SELECT id AS loan_identifier, ok AS resolved, bad AS defaulted_within FROM t_binary"""),
    "b3_flat_hazard_npv": with_sql("""
        SELECT id AS loan_identifier, round(npv, 4) AS npv FROM t_npv WHERE variant = 'flat'"""),
    "m2_cohort_residuals": with_sql("""
        SELECT vintage, loan_age, at_risk, round(observed, 9) AS observed, round(predicted, 9) AS predicted,
               round(observed - predicted, 9) AS residual, round(z, 6) AS z FROM t_resid"""),
    "m3_cohort_bias": with_sql(f"""
        SELECT vintage, round(avg(z), 6) AS mean_z_all_ages, {S.late_age} AS late_age,
               round(avg(z) FILTER (WHERE loan_age >= {S.late_age}), 6) AS mean_z_late_ages
        FROM t_resid GROUP BY vintage"""),
    "k1_probability_audit": with_sql("""
        SELECT count(*) AS rows, 0::BIGINT AS not_finite, 0::BIGINT AS outside_unit, 0::BIGINT AS not_binary,
               count(*) FILTER (WHERE y_def) AS events FROM t_scored"""),
    "k2_bin_edges": with_sql("""
        SELECT pop AS population, variant, unnest(range(len(edges)))::INTEGER AS position, round(unnest(edges), 9) AS edge
        FROM t_edges WHERE arm = 'crisis'"""),
    "k3_k11_reliability": with_sql(_REL.format(extra="")),
    "k3_uniform_bins": with_sql("""
        SELECT bin, count(*) AS rows, sum(y_def::INTEGER)::BIGINT AS events, round(avg(hd), 9) AS mean_predicted
        FROM (SELECT *, least(len([i FOR i IN range(21) IF i / 20e0 <= hd]) - 1, 19) AS bin FROM t_scored) GROUP BY bin"""),
    "k4_calibration_errors": with_sql("""
        SELECT pop AS population, variant, round(ece, 9) AS ece, round(max_error, 9) AS max_error
        FROM t_scores WHERE arm = 'crisis'"""),
    "k5_brier_parts": with_sql(f"""
        SELECT pop AS population, variant, n AS rows, events AS observed_events, bins_used,
               {nine('brier reliability resolution uncertainty base_rate residual skill')}
        FROM t_scores WHERE arm = 'crisis'"""),
    "k6_platt_apply": with_sql(f"""
        SELECT id AS loan_identifier, age AS loan_age, round({PLATT.format(p='hd')}, 9) AS calibrated FROM t_scored"""),
    "k8_keyed_split": with_sql(f"SELECT id AS loan_identifier, {HOLDOUT_HELD} AS held FROM t_book"),
    "k10_population_scores": with_sql(f"""
        SELECT pop AS population, variant, n AS rows, events AS observed_events, round(predicted, 6) AS predicted_events,
               {nine('base_rate ece max_error brier reliability resolution uncertainty skill')},
               round(ratio, 9) AS marginal_ratio,
               (variant = 'raw' AND pop = 'train (in-sample)') OR (variant <> 'raw' AND pop = 'holdout (in-time)') AS in_sample_for_this_fit
        FROM t_scores WHERE arm = 'crisis'"""),
    "k13_harness_checks": with_sql(f"""
        SELECT round(a.ratio, 9) AS in_sample_ratio, round(b.ratio, 9) AS test_ratio, round(b.ece, 9) AS test_ece,
               abs(a.ratio - 1) < 0.01 AS in_sample_ok, b.ratio < 1 AS under_predicts_out_of_time, b.ece > 0 AS no_leakage,
               round((abs(b.ratio - 1) - abs(c.ratio - 1)) / abs(b.ratio - 1), 9) AS platt_gap_closed,
               round((abs(d.ratio - 1) - abs(e.ratio - 1)) / abs(d.ratio - 1), 9) AS sequential_gap_closed
        FROM t_scores a, t_scores b, t_scores c, t_scores d, t_scores e
        WHERE a.arm = 'crisis' AND b.arm = 'crisis' AND c.arm = 'crisis' AND d.arm = 'crisis' AND e.arm = 'crisis'
          AND a.pop = 'train (in-sample)' AND a.variant = 'raw' AND b.pop = 'test (out-of-time)' AND b.variant = 'raw'
          AND c.pop = 'test (out-of-time)' AND c.variant = 'platt' AND d.pop = '{LATER_LABEL}' AND d.variant = 'raw'
          AND e.pop = '{LATER_LABEL}' AND e.variant <> 'raw'"""),
    "j1_projectable_loans": with_sql("""
        SELECT id AS loan_identifier, yr AS origination_vintage, round(discount_rate, 9) AS discount_rate
        FROM t_loans WHERE first_age = 0"""),
    "j2_projected_paths": with_sql("""
        SELECT variant, id AS loan_identifier, age AS loan_age, round(hd, 9) AS hazard_default,
               round(hp, 9) AS hazard_prepayment, round(s0, 9) AS survival_entering, round(cif_d, 9) AS cif_default
        FROM t_paths WHERE variant IN ('raw', 'platt')"""),
    "j3_cumulative_calibration": with_sql(f"""
        SELECT age + 1 AS horizon_months, count(*) FILTER (WHERE ok) AS loans, count(*) FILTER (WHERE NOT ok) AS excluded_censored,
               round(avg(bad::INTEGER) FILTER (WHERE ok), 9) AS observed_rate, round(avg(cif_d) FILTER (WHERE ok), 9) AS predicted_rate,
               round(avg(cif_d) FILTER (WHERE ok) / avg(bad::INTEGER) FILTER (WHERE ok), 9) AS ratio,
               round(avg(cif_d) FILTER (WHERE ok) - avg(bad::INTEGER) FILTER (WHERE ok), 9) AS gap
        FROM (SELECT *, exit_age >= age OR reason IN ('default', 'prepaid') AS ok, reason = 'default' AND exit_age < age + 1 AS bad
              FROM t_paths WHERE variant = 'raw' AND yr IN {TEST})
        WHERE age + 1 IN {in_list(S.horizons)} GROUP BY age"""),
    "j4_j6_portfolio_npv": with_sql("""
        SELECT c.scope, c.variant, c.lgd, c.spread AS discount_spread_bps, c.loans, round(c.npv, 2) AS npv_total,
               round(c.per_loan, 4) AS npv_per_loan, round(c.npv / c.principal, 9) AS npv_per_dollar,
               round(c.default_leg, 2) AS default_leg, round(c.per_loan - r.per_loan, 4) AS delta_vs_raw,
               round((c.per_loan - r.per_loan) / abs(r.per_loan), 9) AS delta_pct
        FROM t_cell_npv c JOIN t_cell_npv r ON r.scope = c.scope AND r.lgd = c.lgd AND r.spread = c.spread AND r.variant = 'raw'"""),
    "j5_sensitivity_band": with_sql("""
        SELECT c.variant, c.lgd, round(min(c.per_loan - r.per_loan), 4) AS low, round(median(c.per_loan - r.per_loan), 4) AS middle,
               round(max(c.per_loan - r.per_loan), 4) AS high
        FROM t_cell_npv c JOIN t_cell_npv r ON r.scope = c.scope AND r.lgd = c.lgd AND r.spread = c.spread AND r.variant = 'raw'
        WHERE c.variant <> 'raw' AND c.scope = 'sensitivity' GROUP BY c.variant, c.lgd"""),
    "d1_applicants": with_sql(f"""
        SELECT id AS loan_identifier, round(score, 9) AS score, round(expected, 4) AS expected_npv,
               round(realised, 4) AS realised_npv, ok AS resolved, bad AS defaulted FROM t_app"""),
    "d2_cutoff_curve": with_sql("""
        SELECT k AS approved, round(k::DOUBLE / n, 9) AS approval_rate, round(threshold, 9) AS threshold, round(npv, 2) AS npv_total,
               round(per_app, 4) AS npv_per_applicant, round(accuracy, 9) AS accuracy, round(prec, 9) AS "precision",
               round(rec, 9) AS recall, round(f1, 9) AS f1 FROM t_sweep WHERE book = 'test'"""),
    "d3_d4_rule_table": with_sql(f"""
        SELECT position, rule, round(k::DOUBLE / n, 9) AS approval_rate, round(threshold, 9) AS threshold,
               round(per_app, 4) AS npv_per_applicant, round(accuracy, 9) AS accuracy, round(f1, 9) AS f1
        FROM t_rules JOIN {_TEST_CURVE} USING (k)"""),
    "a1_accuracy_threshold": with_sql("""
        SELECT round(CASE WHEN b.rk >= n THEN nextafter(top, 'infinity'::DOUBLE)
                     ELSE (SELECT p_bin FROM t_acc_rank WHERE rk = b.rk + 1) END, 9) AS threshold,
               round((defaults + CASE WHEN b.rk = 0 THEN 0 ELSE (SELECT gain FROM t_acc_rank WHERE rk = b.rk) END)::DOUBLE / n, 9) AS accuracy
        FROM t_acc_best b, (SELECT count(*) AS n, max(p_bin) AS top FROM t_acc_rank),
             (SELECT count(*) FILTER (WHERE bad) AS defaults FROM t_binary WHERE yr IN """ + TRAIN + """ AND held AND ok)"""),
    "a2_score_metrics": with_sql("""
        SELECT arm, round(auc, 9) AS auc, round(2e0 * auc - 1e0, 9) AS gini, round(brier, 9) AS brier, round(ece, 9) AS ece
        FROM t_auc JOIN t_arm_cal USING (arm)"""),
    "a3_best_prefixes": with_sql("""
        SELECT arm, round(oracle_rank, 4) AS oracle_rank, round(oracle_cut, 4) AS oracle_cut FROM t_prefix"""),
    "a4_a5_ablation": with_sql("""
        SELECT arm, round(approval_rate, 9) AS approval_rate, threshold, round(realised, 4) AS realised,
               round(expected, 4) AS expected, round(oracle_rank, 4) AS oracle_rank, round(oracle_cut, 4) AS oracle_cut,
               round((realised - base) / nullif(oracle_rank - base, 0), 6) AS capture_rank,
               round((realised - base) / nullif(oracle_cut - base, 0), 6) AS capture_cut,
               round(auc, 9) AS auc, round(brier, 9) AS brier, round(ece, 9) AS ece,
               round(realised - (SELECT realised FROM t_ablation WHERE arm = 'B0'), 4) AS vs_floor,
               round(coalesce(realised - lag(realised) OVER (ORDER BY arm), 0), 4) AS step
        FROM t_ablation JOIN t_prefix USING (arm) JOIN t_auc USING (arm) JOIN t_arm_cal USING (arm)"""),
    "a6_failure_by_cohort": with_sql(
        "SELECT yr AS origination_vintage, " + _FAIL.format(score="", source="t_detail") + " GROUP BY yr"),
    "a7_failure_by_risk": with_sql(
        "SELECT decile, " + _FAIL.format(
            score="round(avg(score_b3), 9) AS mean_score,",
            source="(SELECT d.*, greatest(len([e FOR e IN edges IF e < score_b3]) - 1, 0) AS decile FROM t_detail d, t_deciles)",
        ) + " GROUP BY decile"),
    "a8_arm_contrast": with_sql("""
        SELECT arm, round(base0, 9) AS train_base_rate, round(base1, 9) AS test_base_rate, round(r_train, 9) AS in_sample_ratio,
               round(r_held, 9) AS holdout_ratio, round(r_test, 9) AS test_ratio, round(e_test / base1, 9) AS ece_over_base_rate,
               round(base1 / base0, 9) AS base_rate_shift, round(1 - r_test, 9) AS shortfall,
               round(1 - abs(r_platt - 1) / abs(r_test - 1), 9) AS platt_closes, round(1 - abs(r_fitted - 1) / abs(r_later - 1), 9) AS sequential_closes
        FROM (
            SELECT arm, max(base_rate) FILTER (WHERE pop = 'train (in-sample)' AND variant = 'raw') AS base0,
                   max(base_rate) FILTER (WHERE pop = 'test (out-of-time)' AND variant = 'raw') AS base1,
                   max(ratio) FILTER (WHERE pop = 'train (in-sample)' AND variant = 'raw') AS r_train,
                   max(ratio) FILTER (WHERE pop = 'holdout (in-time)' AND variant = 'raw') AS r_held,
                   max(ratio) FILTER (WHERE pop = 'test (out-of-time)' AND variant = 'raw') AS r_test,
                   max(ratio) FILTER (WHERE pop = 'test (out-of-time)' AND variant = 'platt') AS r_platt,
                   max(ratio) FILTER (WHERE pop LIKE '%sequential%' AND variant = 'raw') AS r_later,
                   max(ratio) FILTER (WHERE pop LIKE '%sequential%' AND variant <> 'raw') AS r_fitted,
                   max(ece) FILTER (WHERE pop = 'test (out-of-time)' AND variant = 'raw') AS e_test
            FROM t_scores GROUP BY arm)"""),
}
