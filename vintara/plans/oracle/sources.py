"""Oracle statements for the source, audit and sink operators."""

from __future__ import annotations

import vintara.plans.oracle.panel  # noqa: F401  (defines t_curves)
from vintara.plans.oracle.base import TEST, with_sql

STATEMENTS = {
    "s1_scan_text": with_sql("""
        SELECT id::VARCHAR AS loan_identifier, CASE WHEN id % 5 = 0 THEN 'FIRST "QUOTED SELLER' ELSE 'OTHER' END AS seller_name,
               CASE WHEN id % 10 = 0 THEN '000' ELSE lpad((id % 1000)::VARCHAR, 3, '0') END AS postal_code,
               coalesce(fico::VARCHAR, '9999') AS classic_fico, NULL::VARCHAR AS vantagescore_4_0 FROM t_book"""),
    "s2_cohort_stamp": with_sql("SELECT yr AS origination_vintage, count(*) AS rows FROM t_perf GROUP BY yr"),
    "s2_missing_cohorts": with_sql("""
        SELECT max(yr) + 1 AS origination_vintage, 'origination' AS kind FROM t_book
        UNION ALL SELECT max(yr) + 1, 'performance' FROM t_perf"""),
    "s3_typed_origination": with_sql("""
        SELECT id AS loan_identifier, yr AS origination_vintage, fico AS classic_fico, dti AS original_debt_to_income_ratio,
               CASE WHEN id % 50 <> 0 THEN units::INTEGER END AS number_of_units, round(upb, 4) AS original_upb,
               first_home AS first_time_homebuyer_indicator,
               CASE WHEN id % 10 <> 0 THEN lpad((id % 1000)::VARCHAR, 3, '0') END AS postal_code,
               make_date(yr, 3, 1) AS first_payment_date_date,
               CASE WHEN id % 40 <> 0 THEN DATE '2030-01-01' END AS maturity_date_date FROM t_book"""),
    "s3_typed_performance": with_sql("""
        SELECT id AS loan_identifier, month AS period_date, CASE WHEN NOT (id % 30 = 0 AND period = 1) THEN age END AS loan_age,
               round(bal, 4) AS current_actual_upb, status AS current_loan_delinquency_status, zb AS zero_balance_code,
               round(loss, 5) AS actual_loss, NULL::INTEGER AS estimated_loan_to_value FROM t_perf"""),
    "s4_key_audit": with_sql("""
        SELECT 'origination' AS "table", count(*) AS duplicate_keys FROM (SELECT id FROM t_book GROUP BY id HAVING count(*) > 1)
        UNION ALL SELECT 'performance', count(*) FROM (SELECT id FROM t_perf GROUP BY id, period HAVING count(*) > 1)
        UNION ALL SELECT 'line items', count(*) FROM
            (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"""),
    "s5_cast_losses": with_sql("""
        SELECT 'origination' AS "table", 'number_of_units' AS "column", count(*) AS lost FROM t_book WHERE id % 50 = 0
        UNION ALL SELECT 'performance', 'loan_age', count(*) FROM t_perf WHERE id % 30 = 0 AND period = 1"""),
    "s6_load_summary": with_sql("""
        SELECT 'origination' AS "table", count(*) AS rows, count(DISTINCT id) AS loans,
               array_to_string(list_sort(list(DISTINCT yr)), ',') AS cohorts FROM t_book
        UNION ALL SELECT 'performance', count(*), count(DISTINCT id), array_to_string(list_sort(list(DISTINCT yr)), ',') FROM t_perf"""),
    "s7_pruned_panel": with_sql(f"""
        SELECT id AS loan_identifier, yr AS origination_vintage, age AS loan_age, y_def AS default_event
        FROM t_panel WHERE yr IN {TEST}"""),
    "s8_report_sink": with_sql("""
        SELECT vintage, loan_age, at_risk, round(cif_default, 9) AS cif_default FROM t_curves"""),
}
