"""Oracle statements for the panel and curve operators."""

from __future__ import annotations

from vintara.plans.oracle.base import H, S, TEST, TRAIN, cte, end_reason, first_end, with_sql

# Curves from their definitions: a survival is the product over all earlier ages, an incidence the sum over them, each
# a self-contained list expression over the cohort's ordered risk sets.
cte("t_risk", """
SELECT yr, age, count(*) AS at_risk, count_if(y_def) AS defaults, count_if(y_pre) AS prepayments,
       count_if(leaves AND NOT y_def AND NOT y_pre AND reason != 'administrative_censor') AS censored
FROM t_panel GROUP BY ALL
""")
cte("t_cohorts", """
SELECT yr, list({'age': age, 'n': at_risk, 'd': defaults, 'p': prepayments, 'c': censored,
                 'd_rate': defaults::DOUBLE / at_risk, 'p_rate': prepayments::DOUBLE / at_risk} ORDER BY age) AS r
FROM t_risk GROUP BY yr
""")
cte("t_stay", """
SELECT c.*, (SELECT count(DISTINCT id) FROM t_panel p WHERE p.yr = c.yr) AS cohort_size,
       list_transform(range(0, len(r) + 1), lambda i: coalesce(list_product(list_transform(r[1:i], lambda x: 1e0 - x.d_rate - x.p_rate)), 1e0)) AS alive
FROM t_cohorts c
""")
cte("t_curves", f"""
SELECT yr AS vintage, r[i].age AS loan_age, cohort_size, r[i].n AS at_risk, r[i].d AS defaults, r[i].p AS prepayments, r[i].c AS censored,
       r[i].d_rate AS hazard_default, r[i].p_rate AS hazard_prepay, alive[i] AS survival_entering, alive[i + 1] AS survival,
       1e0 - list_product(list_transform(r[1:i], lambda x: 1e0 - x.d_rate)) AS km_default,
       list_sum(list_transform(range(1, i + 1), lambda j: alive[j] * r[j].d_rate)) AS cif_default,
       list_sum(list_transform(range(1, i + 1), lambda j: alive[j] * r[j].p_rate)) AS cif_prepay,
       list_sum(list_transform(r[1:i], lambda x: x.d)) / cohort_size::DOUBLE AS naive_default,
       list_sum(list_transform(r[1:i], lambda x: x.p)) / cohort_size::DOUBLE AS naive_prepay,
       list_sum(list_transform(r[1:i], lambda x: x.c)) / cohort_size::DOUBLE AS naive_censored,
       1e0 - list_sum(list_transform(r[1:i], lambda x: x.d + x.p + x.c)) / cohort_size::DOUBLE AS not_yet_exited_share
FROM (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM t_stay) WHERE r[i].age <= {H}
""")
cte("t_calendar", f"""
SELECT yr AS vintage, month AS calendar_month, avg(age) AS mean_loan_age, count(*) AS at_risk,
       count(*) FILTER (WHERE y_def) AS defaults
FROM t_panel WHERE age <= {H} GROUP BY yr, month HAVING count(*) >= 20
""")

_EXIT_COLUMNS = """
id AS loan_identifier, yr AS origination_vintage, first_age AS first_observed_age,
last_age AS last_eligible_age, n_in AS eligible_months, n_all AS observed_months_total,
term AS original_loan_term, entry_term AS entry_implied_term, late_age AS first_delinquent_age,
event_age AS credit_event_age, prepaid_age, informative_age AS informative_exit_age, default_age,
exit_age, late_age_all AS first_delinquent_age_observed, event_age_all AS credit_event_age_observed,
late_month AS first_delinquent_month_observed, event_month AS credit_event_month_observed,
datediff('month', late_month, event_month) AS months_delinquent_to_disposition,
reason AS exit_reason, off_clock, any_too_late AS any_delinquency_exceeds_loan_age,
term_differs AS entry_term_mismatch, ever_reset AS ever_clock_reset, ever_gap AS ever_month_gap,
before_reset AS age_before_clock_reset, coalesce(before_reset <= {h}, false) AS clock_reset_within_horizon,
event_age IS NOT NULL AND (late_age IS NULL OR event_age < late_age) AS credit_event_preceded_delinquency,
first_age > {h} AS entered_after_horizon
""".format(h=H)

_PANEL_COLUMNS = """
id AS loan_identifier, yr AS origination_vintage, age AS loan_age, period, month AS period_date,
exit_age, reason AS exit_reason, leaves AS is_exit_month, y_def AS default_event,
y_pre AS prepayment_event, first_age AS first_observed_age, ever_reset AS ever_clock_reset,
round(bal, 4) AS current_actual_upb, status AS current_loan_delinquency_status, missed AS missed_payments,
mod_flag AS modification_flag, zb AS zero_balance_code, round(loss, 5) AS actual_loss,
fico AS classic_fico, cltv AS original_combined_loan_to_value, dti AS original_debt_to_income_ratio,
round(upb, 4) AS original_upb, rate AS original_interest_rate, term AS original_loan_term
"""


def _rounded(columns: str) -> str:
    return ", ".join(f"round({c}, 9) AS {c}" for c in columns.split())


_CURVE = (
    "SELECT vintage, loan_age, at_risk, cohort_size, defaults, prepayments, censored, "
    + _rounded(
        "hazard_default hazard_prepay survival survival_entering km_default cif_default "
        "cif_prepay naive_default naive_prepay naive_censored not_yet_exited_share"
    )
    + " FROM t_curves"
)

STATEMENTS = {
    "adapter_months": with_sql("""
        SELECT id AS loan_identifier, yr AS origination_vintage, period, month AS period_date,
               age AS loan_age, remaining AS remaining_months_to_legal_maturity,
               round(bal, 4) AS current_actual_upb, rate AS current_interest_rate,
               status AS current_loan_delinquency_status, zb AS zero_balance_code,
               round(removed, 4) AS zero_balance_removal_upb, round(loss, 5) AS actual_loss
        FROM t_perf"""),
    "p1_sequence_months": with_sql("""
        SELECT id AS loan_identifier, period, age AS loan_age, age_before AS previous_loan_age,
               is_reset AS loan_age_reset, is_gap AS follows_month_gap FROM t_months"""),
    "p2_classify_months": with_sql("""
        SELECT id AS loan_identifier, period, missed AS missed_payments,
               is_late AS at_or_past_delinquency_threshold, is_event AS terminated_credit_event,
               is_prepaid AS terminated_prepaid, is_informative AS terminated_informative,
               implied_term AS implied_original_term, too_late AS delinquency_exceeds_loan_age
        FROM t_months"""),
    "p3_sticky_breaks": with_sql("""
        SELECT id AS loan_identifier, period, broken AS clock_broken, gapped AS after_month_gap
        FROM t_months"""),
    "p4_eligible_window": with_sql("""
        SELECT id AS loan_identifier, k.period, k.age AS loan_age FROM (SELECT id, unnest(kept) AS k FROM t_usable)"""),
    "p5_p6_loan_histories": with_sql("""
        SELECT id AS loan_identifier, before_reset AS age_before_clock_reset, before_gap AS age_before_month_gap,
               len(resets) > 0 AS ever_clock_reset, len(gaps) > 0 AS ever_month_gap, len(told) AS observed_months_total,
               late_age_all AS first_delinquent_age_observed, event_age_all AS credit_event_age_observed,
               late_month AS first_delinquent_month_observed, event_month AS credit_event_month_observed,
               first_age AS first_observed_age, list_max(list_transform(kept, lambda m: m.age)) AS last_eligible_age,
               len(kept) AS eligible_months, late_age AS first_delinquent_age, event_age AS credit_event_age, prepaid_age,
               informative_age AS informative_exit_age, entry_term AS entry_implied_term
        FROM t_ends"""),
    "p7_loan_exits": with_sql(f"SELECT {_EXIT_COLUMNS} FROM t_exits"),
    "p8_off_clock_kept": with_sql("""
        SELECT reason AS exit_reason, count(*) AS months, count(DISTINCT id) AS loans,
               count(*) FILTER (WHERE y_def) AS events FROM t_panel_all GROUP BY reason"""),
    "p9_default_by_termination": with_sql(f"""
        SELECT yr AS origination_vintage, {end_reason('event_age', 'gone')} AS exit_reason, count(*) AS loans, sum(gone)::BIGINT AS exit_age_total
        FROM (SELECT *, {first_end('event_age', 'prepaid_age', 'informative_age')} AS gone FROM t_ends WHERE len(kept) > 0)
        GROUP BY 1, 2"""),
    "p10_months_to_disposition": with_sql("""
        SELECT yr AS origination_vintage, datediff('month', late_month, event_month) AS months_delinquent_to_disposition,
               count(*) AS loans
        FROM t_exits WHERE late_month IS NOT NULL AND event_month IS NOT NULL GROUP BY 1, 2"""),
    "p11_quality_flags": with_sql(f"""
        SELECT yr AS origination_vintage,
               count(*) FILTER (WHERE event_age IS NOT NULL AND (late_age IS NULL OR event_age < late_age)) AS event_first,
               count(*) FILTER (WHERE first_age > {H}) AS late_entry,
               count(*) FILTER (WHERE before_reset <= {H}) AS reset_inside
        FROM t_exits GROUP BY yr"""),
    "p12_panel": with_sql(f"SELECT {_PANEL_COLUMNS} FROM t_panel"),
    "p13_panel_report": with_sql("""
        SELECT (SELECT count(DISTINCT id) FROM t_book) AS cohort_loans,
               (SELECT count(*) FROM (SELECT DISTINCT id FROM t_perf) ANTI JOIN t_left USING (id)) AS loans_without_eligible_months,
               (SELECT count(*) FROM t_panel) AS rows,
               (SELECT count(DISTINCT id) FROM t_panel) AS loans,
               (SELECT count(*) FROM t_panel WHERE y_def) AS events,
               (SELECT count(*) FROM t_exits WHERE first_age > 0) AS left_truncated_loans,
               (SELECT count(*) FROM t_exits WHERE first_age >= 3) AS seasoned_loans,
               (SELECT count(*) FROM t_exits WHERE off_clock) AS off_clock_loans,
               (SELECT count(*) FROM t_exits WHERE off_clock) AS excluded_loans,
               (SELECT count(*) FROM t_exits WHERE ever_reset) AS clock_reset_loans,
               (SELECT count(*) FROM t_exits WHERE ever_gap) AS month_gap_loans,
               (SELECT count(*) FROM t_perf ANTI JOIN t_book USING (id)) AS loans_missing_origination,
               (SELECT count(*) FROM t_book ANTI JOIN t_perf USING (id)) AS loans_missing_performance,
               (SELECT count(*) FROM t_exits WHERE reason = 'default') AS exits_default,
               (SELECT count(*) FROM t_exits WHERE reason = 'month_gap_censor') AS exits_month_gap_censor,
               (SELECT round(avg(n), 9) FROM (SELECT count(*) AS n FROM t_panel GROUP BY id)) AS mean_months_at_risk,
               true AS reconciles"""),
    "v1_risk_sets": with_sql("""
        SELECT yr AS vintage, age AS loan_age, at_risk, defaults, prepayments, censored, cohort_size
        FROM t_risk JOIN (SELECT yr, cohort_size FROM t_stay) USING (yr)"""),
    "v2_v5_cohort_curves": with_sql(_CURVE),
    "v6_calendar_hazards": with_sql("""
        SELECT vintage, calendar_month, round(mean_loan_age, 9) AS mean_loan_age, at_risk, defaults,
               round(defaults::DOUBLE / at_risk, 9) AS hazard_default
        FROM (SELECT *, max(calendar_month) OVER (PARTITION BY vintage) AS final FROM t_calendar)
        WHERE calendar_month < final"""),
    "v7_horizon_summary": with_sql(f"""
        SELECT vintage, loan_age, round(cif_default, 9) AS cif_default, round(km_default, 9) AS km_default,
               round(km_default / cif_default, 9) AS km_overstatement,
               round(abs(naive_default - cif_default), 9) AS naive_gap,
               km_default >= cif_default - 1e-12 AS km_at_least_cif,
               CASE WHEN vintage IN {TRAIN} THEN 'train' WHEN vintage IN {TEST} THEN 'test' END AS split
        FROM (SELECT *, max(loan_age) OVER (PARTITION BY vintage) AS final FROM t_curves)
        WHERE loan_age = final"""),
    "v8_smoothed_hazard": with_sql("""
        SELECT vintage, loan_age, round(avg(hazard_default) OVER (PARTITION BY vintage ORDER BY loan_age
               ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 9) AS hazard_default_smooth
        FROM t_curves"""),
}
assert S.exclude_off_clock
